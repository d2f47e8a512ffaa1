"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled documents, are compared
by log-likelihood, normalised by length. An expression is two words, a word, or
a stem of a word. Its count ``N_c`` in a class is a continuation count: in how
many different texts of the class it stands, so that neither a copied document
nor repetition within one adds to it. Counts are discounted, and what is taken
off goes to the shared backoff:

    P_c(g) = (N_c(g) - D_c(g) + n_c * S(g)) / n_c
    D_c(g) = min(N_c(g), E + z * sqrt(E + 1)),   E = n_c * S(g)

``n_c`` are the texts of the class and ``S(g)`` is the shared backoff count, the
share of all documents that hold the expression. The discount follows the
count: it is what the shared counts explain, with ``z`` standard errors. A rare
expression is discounted whole and left to the shared counts; where that holds
in both classes, the next shorter expression stands for it: two words back off
to the second, a word to its stems of 6, 5 and 4 letters, and those to the shared
counts alone, where both classes agree.

A text's score is the mean of ``ln P_toxic - ln P_ordinary`` over its words, by
a logistic scale that is fitted on the training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded, slices

_WORD, _PLAIN = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
STEMS = (6, 5, 4)
CACHE = 200_000


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (_PLAIN if low.isascii() else _WORD).findall(low)


def stems(word: str) -> list[str]:
    """Stems of a word, longest first; ``*`` keeps them apart from words."""
    return [word[:n] + "*" for n in STEMS if len(word) > n]


def by_length(known: set[str]) -> dict[int, set[str]]:
    """The stems among some terms, without their mark, by length."""
    return {n: {g[:-1] for g in known if g.endswith("*") and len(g) == n + 1} for n in STEMS}


def known_terms(own: set[str], known: set[str], cut: dict[int, set[str]]) -> list[str]:
    """The known words and stems of a text's distinct words, each once; ``cut`` as by ``by_length``."""
    return [*known.intersection(own), *(g + "*" for n, held in cut.items() for g in held.intersection([x[:n] for x in own if len(x) > n]))]


def log_ratio(toxic: int, ordinary: int, n_toxic: int, n_ordinary: int, share: float, z: float) -> float | None:
    """ln P_toxic - ln P_ordinary of an expression; None where both counts are discounted whole."""
    kept, p = 0.0, []
    for count, n in ((toxic, n_toxic), (ordinary, n_ordinary)):
        e = n * share
        left = max(0.0, count - e - z * sqrt(e + 1))
        kept += left
        p.append((left + e) / n)
    return log(p[0] / p[1]) if kept else None


class Kept(dict):
    """What a function gives for words, kept in two generations of at most CACHE words each."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        self[word] = got = self.make(word) if got is None else got
        return got


class Model:
    """Log ratios of the expressions that have evidence; all others have none."""

    def __init__(self, ratios: dict[str, float]):
        self.ratios = ratios
        self.heads = {g.split(" ")[0] for g in ratios if " " in g}
        self.weight, self.constant = 1.0, -3.0
        self.cache = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": None}

    def word(self, w: str) -> float:
        return next((self.ratios[g] for g in (w, *stems(w)) if g in self.ratios), 0.0)

    def ratio(self, text: str | None) -> float:
        """Log-likelihood ratio per word; 0 without words."""
        if self.cache is None:
            self.cache = Kept(self.word)
        w = words(text)
        r = list(map(self.cache.__getitem__, w))
        if self.heads:
            for i in [i for i, x in enumerate(w[:-1], 1) if x in self.heads]:
                r[i] = self.ratios.get(f"{w[i - 1]} {w[i]}", r[i])
        return sum(r) / len(r) if r else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + exp(-min(max(self.weight * self.ratio(text) + self.constant, -700), 700)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 50) -> np.ndarray:
    """Newton steps for a small logistic regression; the last column is the constant."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], penalty * len(x))
    reg[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + reg * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(spark: SparkSession, docs: DataFrame, labelled: DataFrame, sample_rows: int = 12_000, z: float = 3.0) -> Model:
    """docs: doc_id, text (all documents); labelled: doc_id, toxic (0 or 1).

    At most ``sample_rows`` labelled rows, those of smallest hash, are read for
    the class counts, equal texts of a class once; the shared counts are those
    of all documents. Other columns, null ids, and labels that are null or
    neither 0 nor 1 are ignored; a repeated id is toxic if one of its labels
    is. Null and empty texts count as documents without words. Without labelled
    documents of both classes no text is toxic.
    """
    ws = Workspace(spark, "toxicity")
    docs = docs.select("doc_id", "text")
    chosen = labelled.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = ws.stage(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "chosen")  # 12 bytes a row
    read = ws.stage(docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").distinct(), "labelled")
    n = {r["toxic"]: r["n"] for r in read.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model({})
    n_docs = docs.count()

    def counted(units) -> DataFrame:
        """(term, a, b): the toxic and the ordinary texts with an expression, where either count can outlast its discount."""

        def run(batches):
            for b in slices(batches, 0, 1 << 20):
                seen = Counter()
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seen.update([(g, y) for g in units(words(t))])
                term, toxic = zip(*seen) if seen else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "toxic", "n"])

        side = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
        got = read.mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(side(1).alias("a"), side(0).alias("b"))
        least = lambda y: F.lit(n[y] / max(1, n_docs)) * (F.col("a") + F.col("b"))
        return got.where((F.col("a") > least(1) + z * F.sqrt(least(1) + 1)) | (F.col("b") > least(0) + z * F.sqrt(least(0) + 1)))

    def single(w: list[str]) -> set[str]:
        own = set(w)
        return own.union(*map(stems, own))

    counts = {r["term"]: (r["a"], r["b"]) for r in counted(single).collect()}
    often = spark.sparkContext.broadcast({g for g in counts if not g.endswith("*")})

    def double(w: list[str]) -> set[str]:
        """Two words, each of which has enough texts itself."""
        known = often.value
        return {f"{v} {x}" for v, x in zip(w, w[1:]) if v in known and x in known}

    counts |= {r["term"]: (r["a"], r["b"]) for r in counted(double).collect()}
    held = spark.sparkContext.broadcast(({g for g in counts if " " not in g}, {tuple(g.split(" ")) for g in counts if " " in g}))

    def shared(batches):
        found, twos, (known, pairs) = Counter(), Counter(), held.value
        cut = by_length(known)
        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                w = words(t)
                found.update(known_terms(set(w), known, cut))
                twos.update(pairs.intersection(zip(w, w[1:])))
        terms = [*found, *map(" ".join, twos)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([*found.values(), *twos.values()], pa.int64())], names=["term", "n"])

    total = docs.select("text").mapInArrow(shared, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = {r["term"]: r["n"] for r in total.collect()}  # at most as many rows as ``counts``
    ratios = {g: log_ratio(a, b, n[1], n[0], max(1, total.get(g, 0)) / n_docs, z) for g, (a, b) in counts.items()}
    model = Model({g: r for g, r in ratios.items() if r is not None})
    sent = spark.sparkContext.broadcast(model)

    def compared(batches):
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.ratio(t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["ratio", "toxic"])

    rows = read.mapInArrow(compared, "ratio double, toxic int").toArrow()  # sample_rows at most
    x, y = rows.column("ratio").to_numpy(), rows.column("toxic").to_numpy()
    scale = max(x.std(), 1e-9)
    weight, constant = logistic(np.stack([x / scale, np.ones(len(x))], 1), y.astype(float))
    model.weight, model.constant = float(weight / scale), float(constant)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in ``keep``, then score (0 to 1) and predicted (1 from one half).

    Null, empty and wordless texts get the score of a text without evidence;
    repeated rows are scored each; texts of any length are scored whole; an
    empty table gives no rows. Columns of ``keep`` that are named score or
    predicted give way to the operator's.
    """
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    own = () if text in keep else (F.col(text).alias("scored_text"),)
    src = docs.select(*keep, *own)
    at, n = (len(keep) if own else keep.index(text)), len(keep)
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, at):
            s = [held.value.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*keep, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])
    return src.mapInArrow(run, f"{fields}, score double, predicted int")
