"""Product codes for vectors: integer codebooks trained by nearest entries, with a
kd-tree for each codebook.

A vector becomes the integers ``floor(1024 * x)`` and is cut into parts. Every
round broadcasts the codebooks (at most 256 entries a part, each with its kd-tree), finds
each part's nearest entry, and sums parts by entry: first inside each task, then
by a shuffle of those sums. All arithmetic is on 64-bit integers, so results do
not depend on the order of rows or tasks. The table is read once a round, and
nothing but sums and codes is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .vectors import matrix

LEAF, WORK = 8, 1 << 20
#: components of codebooks that one pass broadcasts at most, unless one dimension's alone are more
BROADCAST = 4_000_000


class Tree:
    """A kd-tree over the rows of one codebook.

    Each node has the box of its entries. A box is split at the median of its
    longest side, down to leaves of at most LEAF entries; entries that are all
    equal make one leaf with the lowest of their indexes, which wins all ties.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.below, self.held = [], [], [], []
        self._node(np.arange(len(entries)))

    def _node(self, which: np.ndarray) -> int:
        rows, me = self.entries[which], len(self.low)
        low, high = rows.min(axis=0), rows.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.below.append(None)
        self.held.append(None)
        if (low == high).all():
            self.held[me] = which[:1]
        elif len(which) <= LEAF:
            self.held[me] = which
        else:
            order = np.argsort(rows[:, np.argmax(high - low)], kind="stable")
            half = len(which) // 2
            self.below[me] = (self._node(np.sort(which[order[:half]])), self._node(np.sort(which[order[half:]])))
        return me

    def _bound(self, node: int, queries: np.ndarray) -> np.ndarray:
        """The squared distance to the node's box: no entry of it is nearer."""
        out = np.maximum(np.maximum(self.low[node] - queries, queries - self.high[node]), 0)
        return np.einsum("ij,ij->i", out, out)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, of equals the lowest index.

        Branch and bound for all queries together: each goes into the nearer
        box first and into the other unless its bound exceeds the best distance;
        a bound that equals it is visited, since a lower index may be there.
        """
        best = np.full(len(queries), np.iinfo(np.int64).max)
        found = np.zeros(len(queries), dtype=np.int64)

        def leaf(node: int, rows: np.ndarray) -> None:
            which = self.held[node]
            step = max(1, WORK // max(1, len(which) * queries.shape[1]))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                apart = queries[some][:, None, :] - self.entries[which][None]
                far = np.einsum("ijk,ijk->ij", apart, apart)
                first = far.argmin(axis=1)
                far, index = far[np.arange(len(some)), first], which[first]
                better = (far < best[some]) | (far == best[some]) & (index < found[some])
                best[some[better]], found[some[better]] = far[better], index[better]

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.held[node] is not None:
                return leaf(node, rows)
            left, right = self.below[node]
            to_left, to_right = self._bound(left, queries[rows]), self._bound(right, queries[rows])
            near = to_left <= to_right
            for side, bound, own in ((left, to_left, near), (right, to_right, ~near), (right, to_right, near), (left, to_left, ~near)):
                visit(side, rows[own & (bound <= best[rows])])

        visit(0, np.arange(len(queries)))
        return found, best


def borders(dim: int, parts: int) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x), held inside the range in which squared distances of whole vectors fit 64 bits (131,072 and more for x, up to 64 components)."""
    most = 1 << ((62 - max(1, vectors.shape[1] - 1).bit_length()) // 2 - 1)
    return np.clip(np.floor(vectors * 1024.0), -most, most).astype(np.int64)


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) of a batch's vectors, for each dimension."""
    vectors = batch.column(column)
    sizes = np.diff(vectors.offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        own = vectors if len(rows) == len(sizes) else vectors.take(pa.array(rows))
        step = max(1, WORK // max(1, int(dim)))
        for at in range(0, len(rows), step):
            part = own.slice(at, step)
            yield rows[at : at + step], integers(matrix(part) if dim else np.zeros((len(part), 0)))


def _sums(trees, parts: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by (dim, part, entry, position); column 0 has the vectors."""
    total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, whole in _by_dimension(batch, 0):
            dim = whole.shape[1]
            cut = borders(dim, parts)
            for p, tree in enumerate(trees.value[dim]):
                mine = whole[:, cut[p] : cut[p + 1]]
                index, _ = tree.nearest(mine)
                add, n = total.setdefault((dim, p), (np.zeros_like(tree.entries), np.zeros(len(tree.entries), dtype=np.int64)))
                np.add.at(add, index, mine)
                n += np.bincount(index, minlength=len(n))
    for (dim, p), (add, n) in total.items():
        used, width = np.flatnonzero(n), add.shape[1]
        held = [np.full(len(used) * width, dim), np.full(len(used) * width, p), np.repeat(used, width), np.tile(np.arange(width), len(used)), add[used].ravel(), np.repeat(n[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held], names=["dim", "part", "entry", "at", "total", "n"])


def _codes(trees, digests: dict[int, str], parts: int, column: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Other columns as they are, with code, error and the digest of the codebooks; ``column`` has the vectors."""
    for batch in batches:
        code, error = np.empty(batch.num_rows, dtype=object), np.zeros(batch.num_rows, dtype=np.int64)
        digest = np.empty(batch.num_rows, dtype=object)
        for rows, whole in _by_dimension(batch, column):
            dim = whole.shape[1]
            cut = borders(dim, parts)
            text = np.full(len(rows), "", dtype=object)
            for p, tree in enumerate(trees.value[dim]):
                index, far = tree.nearest(whole[:, cut[p] : cut[p + 1]])
                text += np.array([f"{i:02x}" for i in range(256)], dtype=object)[index]
                error[rows] += far
            code[rows], digest[rows] = text, digests[dim]
        rest = [c for i, c in enumerate(batch.columns) if i != column]
        names = [n for i, n in enumerate(batch.schema.names) if i != column]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(code, pa.string()), pa.array(error), pa.array(digest, pa.string())], names=[*names, "code", "error", "codebooks_sha256"])


def kept_vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): rows whose vector is not null and has only finite components."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def train(spark: SparkSession, kept: DataFrame, dims: list[int], parts: int, entries: int, rounds: int) -> dict[int, list[np.ndarray]]:
    """The codebooks of some dimensions after all rounds; on the driver, at most ``entries`` vectors of each dimension."""
    books = {}
    for dim in dims:
        first = kept.where(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"]
        whole, cut = integers(matrix(first) if dim else np.zeros((len(first), 0))), borders(dim, parts)
        books[dim] = [whole[:, cut[p] : cut[p + 1]].copy() for p in range(parts)]
    own = kept.where(F.size("v").isin(dims)).select("v")
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast({dim: [Tree(b) for b in book] for dim, book in books.items()})
        sums = own.mapInArrow(partial(_sums, trees, parts), "dim long, part long, entry long, at long, total long, n long")
        got = sums.groupBy("dim", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        dim, part, entry, at, total, n = (c.to_numpy() for c in got.columns)
        for d, book in books.items():
            for p in range(parts):
                mine = (dim == d) & (part == p)
                book[p][entry[mine], at[mine]] = total[mine] // n[mine]
        trees.destroy()
    return books


def compress(
    spark: SparkSession, df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4
) -> DataFrame:
    """One row per vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components have no row;
    zero vectors do. ``code`` has two hexadecimal digits a part. ``error`` is the squared
    distance to what the code stands for, ``label_error`` its sum over equal
    labels (nulls together). Codebooks start as the ``entries`` rows of smallest vec_id, ties by vector, null
    ids last; with fewer rows they are smaller. Vectors of another dimension have codebooks of their
    own, and parts of a dimension that ``parts`` does not divide differ by one
    component. Repeated rows are coded each; an empty table gives no rows;
    other columns are ignored.
    """
    if not (1 <= entries <= 256 and parts >= 1 and rounds >= 0):
        raise ValueError("1 to 256 entries, at least one part and no negative number of rounds")
    ws = Workspace(spark, "vector-codes")
    kept = kept_vectors(df, vec_id, embedding, label)
    dims = sorted(r["dim"] for r in kept.groupBy(F.size("v").alias("dim")).agg(F.lit(1)).collect())  # sizes that occur, not rows
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], *T.StructType.fromDDL("code string, error long, codebooks_sha256 string").fields])
    coded = spark.createDataFrame([], schema)
    while dims:
        some = [dims.pop(0)]
        while dims and (sum(some) + dims[0]) * entries <= BROADCAST:
            some.append(dims.pop(0))
        books = train(spark, kept, some, parts, entries, rounds)
        digests = {d: hashlib.sha256(",".join(str(x) for b in book for x in b.ravel().tolist()).encode()).hexdigest() for d, book in books.items()}
        trees = spark.sparkContext.broadcast({dim: [Tree(b) for b in book] for dim, book in books.items()})
        out = kept.where(F.size("v").isin(some)).mapInArrow(partial(_codes, trees, digests, parts, 2), schema)
        coded = coded.unionByName(out)
    coded = ws.stage(coded, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
