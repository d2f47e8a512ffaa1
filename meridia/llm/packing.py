"""Sequence packing by non-negative least squares over a length histogram.

Every document is cut into full windows and one remainder. The histogram of
remainders (at most ``window`` counts, whatever the corpus) goes to the driver,
where combinations of at most three lengths that fill a window are enumerated
on a grid, their repeat counts are solved as a non-negative least squares
problem, rounded down, and the residual lengths are packed greedily. The plan
then maps (length, rank) to (sequence, offset); pieces get their rank from a
salted count, so one frequent length is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, slices
from .tokens import word_tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long, padded_length long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares under x >= 0 by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if free.all() or w.max() <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        free[int(w.argmax())] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 1e-12).all():
                x = z
                break
            bad = free & (z <= 1e-12)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-10
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` grid lengths that fill the window."""
    out: list[tuple[int, ...]] = [(bins,)]
    for d in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, bins), d - 1):
            last = bins - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


def plan(counts: dict[int, int], window: int = 2048, grid: int = 16, depth: int = 3) -> tuple[np.ndarray, int]:
    """(rows of length, first rank, pieces per sequence, first sequence, offset, total; number of sequences).

    Sorted by length and first rank; every piece of ``counts`` is in one row.
    """
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def emit(runs: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        total, at = sum(n * k for n, k in runs), 0
        for n, k in runs:
            rows.append((n, taken[n], k, sequences, at, total))
            taken[n] += k * times
            left[n] -= k * times
            at += n * k
        sequences += times

    if left.get(window):
        emit([(window, 1)], left[window])
    bins = window // grid
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted((k for k, v in left.items() if v), reverse=True):
        by_bin[-(-n // grid)].append(n)
    hist = np.array([0] + [sum(left[n] for n in by_bin.get(b, ())) for b in range(1, bins + 1)], float)
    if hist.sum():
        combos = [c for c in combinations(bins, depth) if all(hist[b] for b in c)]
        if combos:
            a = np.zeros((bins + 1, len(combos)))
            for j, c in enumerate(combos):
                for b in c:
                    a[b, j] += 1
            times = np.floor(nnls(a, hist) + 1e-6)
            for j in np.argsort(-times):
                c, t = combos[j], int(times[j])
                need = {b: c.count(b) for b in c}
                t = min([t, *(sum(left[n] for n in by_bin[b]) // k for b, k in need.items())])
                while t > 0:  # constant lengths as long as each slot's run lasts
                    used: dict[int, int] = defaultdict(int)
                    slots = []
                    for b in c:
                        n = next(n for n in by_bin[b] if left[n] > used.get(n, 0))
                        used[n] += 1
                        slots.append(n)
                    m = min([t, *(left[n] // k for n, k in used.items())])
                    emit(sorted(used.items(), reverse=True), m)
                    t -= m
    lengths = sorted(n for n, v in left.items() if v)
    while lengths:  # residuals: the longest, then what fits best
        room, used = window, defaultdict(int)
        while room:
            k = bisect_right(lengths, room) - 1
            while k >= 0 and left[lengths[k]] <= used.get(lengths[k], 0):
                k -= 1
            if k < 0:
                break
            n = lengths[k]
            fit = min(room // n, left[n] - used[n])
            used[n] += fit
            room -= fit * n
        emit(sorted(used.items(), reverse=True), min(left[n] // k for n, k in used.items()))
        lengths = [n for n in lengths if left[n]]
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def cut(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids (its text's, then ``end_id``): full windows and a remainder."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tok = word_tokenizer(tokenizer)
        for batch in slices(batches, 1):
            out = [[], [], [], [], []]
            for d, ids in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1))):
                raw, n = ids.tobytes() + end, len(ids) + 1
                for s in range(0, n, window):
                    m = min(window, n - s)
                    for col, v in zip(out, (d, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, rows_per_salt: int = 1_000_000) -> DataFrame:
    """Places each piece of each document: PIECES columns, sequence_id, offset, padded_length.

    padded_length is ``window``, or the sequence's tokens where they are a
    power of two. A null or empty text is the end id alone; a null id stays
    null; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. Ids are not stored: pieces carry their checksum, and
    ``sequences`` cuts them again from the text.
    """
    ws = Workspace(spark, "pack")
    pieces = ws.stage(cut(docs, tokenizer, window, end_id), "pieces")
    salts = max(64, pieces.count() // rows_per_salt)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    hist = ws.stage(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "histogram")
    counts = {r["length"]: r["n"] for r in hist.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, window)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = hist.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    if window * salts <= 262_144:  # at most that many rows of 24 bytes
        first = F.broadcast(first)
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start"))
    ranked = pieces.withColumn("within", within).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("within") - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    shift = 1 << 40
    keys = rows[:, 0] * shift + rows[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            r = rows[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - r[:, 1]
            seq, at, total = r[:, 3] + nth // r[:, 2], r[:, 4] + nth % r[:, 2] * length, r[:, 5]
            padded = np.where(total & (total - 1), window, total)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *map(pa.array, (seq, at, padded))], names=[*names, "sequence_id", "offset", "padded_length"])

    return ranked.select(*names, "rank").mapInArrow(place, PLACED)


def sequences(placed: DataFrame, docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, unpadded. doc_id must be unique."""
    def run(batches):
        tok = word_tokenizer(tokenizer)
        for b in slices(batches, 1):
            starts, lengths = b.column(2).to_pylist(), b.column(3).to_pylist()
            ids = [np.append(x, np.uint32(end_id))[s : s + n].astype(np.int32) for x, s, n in zip(tok.encode(b.column(1)), starts, lengths)]
            yield pa.RecordBatch.from_arrays([b.column(4), b.column(5), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    cols = placed.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "start", "length", "sequence_id", "offset")
    parts = cols.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    grouped = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return grouped.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
