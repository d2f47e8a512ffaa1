"""Quality grades by ordinal cumulative-link regression.

    P(grade > k | x) = sigmoid(w . x - t_k),   t_0 < t_1 < ...

One weight vector over hashed words, hashed shapes of tokens and a few shares
is shared by all grades; only the thresholds differ, and they stay ordered
because their gaps are fitted as logarithms. The expected grade is the sum of
the tail probabilities; documents are selected by the tail probability of the
grade that is asked for. Words are many and rare, so their weights have a
penalty of their own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded, slices

SHAPES, WORDS, DENSE = 1 << 14, 1 << 15, 8
SIZE = SHAPES + WORDS + DENSE
CACHE = 50_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]+|_+")


def _hashed(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


def _shape(token: str) -> str:
    """Words by ending and case, numbers by length, marks as they are (the first three)."""
    if token[0].isalpha():
        case = "u" if len(token) > 1 and token.isupper() else "t" if token[0].isupper() else "l"
        return f"{case}{token[-2:].lower()}"
    if token[0].isdigit():
        return f"d{min(len(token), 9)}"
    if token.isspace():
        return "\n" if "\n" in token else " "
    return f"m{token[:3]}"


class _Codes(dict):
    """Of a token, in one number: the bucket of its shape, the bucket of a word (0 for other tokens, else from 1), and its class."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        kind = 0 if token[0].isalpha() else 1 if token[0].isdigit() else 2 if token.isspace() else 3
        up = kind == 0 and len(token) > 1 and token.isupper()
        word = 1 + _hashed("w" + token.lower()) % WORDS if kind == 0 else 0
        code = self[token] = (_hashed("s" + _shape(token)) % SHAPES) << 20 | word << 3 | kind * 2 + up
        return code


_codes = _Codes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text: roots of the shares of its hashed shapes and words, and shares of kinds."""
    tokens = _TOKEN.findall(text or "")
    dense = np.zeros(DENSE)
    dense[0] = 1.0
    last = SHAPES + WORDS + np.arange(DENSE)
    if not tokens:
        dense[7] = 1.0
        return last, dense
    code = np.fromiter(map(_codes.__getitem__, tokens), np.int64, len(tokens))
    kinds = np.bincount(code & 7, minlength=8)
    spoken = code >> 3 & (1 << 17) - 1
    word, times = np.unique(spoken[spoken > 0] - 1, return_counts=True)
    shape, n = np.unique(code >> 20, return_counts=True)
    plain = max(1, kinds[0] + kinds[1])
    dense[1] = kinds[1] / plain
    dense[2] = kinds[6] / len(tokens) * 2
    dense[3] = kinds[2] / len(tokens)
    dense[4] = len(word) / plain
    lines = (text or "").split("\n")
    dense[5] = 1 - len(set(lines)) / len(lines)
    dense[6] = min(1.0, np.log1p(len(tokens)) / 12)
    return np.concatenate([shape, SHAPES + word, last]), np.concatenate([np.sqrt(n / len(tokens)), np.sqrt(times / len(tokens)), dense])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ordinal:
    """Cumulative-link model with shared weights and ordered thresholds."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.w = np.zeros(SIZE)
        self.first, self.gaps = 0.0, np.zeros(max(0, len(grades) - 2))

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 300, rate: float = 0.1, penalty: float = 1e-5, word_penalty: float = 1e-3) -> "Ordinal":
        """Full-batch Adam on the likelihood of the observed grades; y holds indices into ``grades``."""
        ridge = np.full(SIZE, penalty)
        ridge[SHAPES : SHAPES + WORDS] = word_penalty
        at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        col, val = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        n = len(rows)
        theta = [self.w, np.array([self.first]), self.gaps]
        m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, rounds + 1):
            self.w, self.first, self.gaps = theta[0], float(theta[1][0]), theta[2]
            grad = self.gradient(at, col, val, y, n, ridge)[1]
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.first, self.gaps = theta[0], float(theta[1][0]), theta[2]
        return self

    def gradient(self, at: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, n: int, ridge: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(mean negative log-likelihood with its penalty, gradients of the weights, the first threshold and the gaps)."""
        k = len(self.grades)
        score = np.bincount(at, self.w[col] * val, n)
        cut = np.concatenate([[-np.inf], self.thresholds, [np.inf]])
        up = np.where(y + 1 < k, _sigmoid(cut[np.minimum(y + 1, k - 1)] - score), 1.0)
        down = np.where(y > 0, _sigmoid(cut[np.maximum(y, 1)] - score), 0.0)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up), np.where(y > 0, down * (1 - down), 0.0)
        d_score = (du - dd) / p / n
        d_cut = np.bincount(y, -du / p, k)[: k - 1] + np.bincount(y, dd / p, k)[1:]
        loss = float(-np.log(p).mean() + (ridge * self.w**2).sum() / 2)
        return loss, [np.bincount(col, d_score[at] * val, SIZE) + ridge * self.w, np.array([d_cut.sum() / n]), np.array([d_cut[i + 1 :].sum() / n * np.exp(g) for i, g in enumerate(self.gaps)])]

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tail probabilities, expected grade) of each text."""
        score = np.array([float(self.w[c] @ v) for c, v in map(features, texts)])
        tails = self.tails(score)
        steps = np.diff(np.array(self.grades, float))
        return tails, self.grades[0] + tails @ steps


def train(spark: SparkSession, docs: DataFrame, labelled: DataFrame, sample_rows: int = 6_000) -> Ordinal | None:
    """docs: doc_id, text; labelled: doc_id, grade (whole numbers, any number of grades).

    At most ``sample_rows`` labelled rows, those of smallest hash, are read,
    equal texts of a grade once. Other columns, null ids and null grades are
    ignored; a repeated id has its lowest grade; null and empty texts have no
    tokens. None without labelled documents of two grades.
    """
    ws = Workspace(spark, "quality")
    chosen = labelled.select("doc_id", "grade").where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = ws.stage(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "chosen")  # 12 bytes a row

    def run(batches):
        for b in slices(batches, 0):
            got = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([c for c, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float64()))], names=["grade", "col", "val"])

    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade").distinct()
    read = ws.stage(read, "labelled").mapInArrow(run, "grade int, col array<int>, val array<double>").toArrow()
    grades, y = np.unique(read.column("grade").to_numpy(), return_inverse=True)
    if len(grades) < 2:
        return None
    rows = [(np.array(c), np.array(v)) for c, v in zip(read.column("col").to_numpy(), read.column("val").to_numpy())]
    return Ordinal(grades.tolist()).fit(rows, y)


def score(docs: DataFrame, model: Ordinal | None, least: int | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in ``keep``, then expected_grade, tail_probability and selected.

    tail_probability is that of a grade of ``least`` or more (the second-lowest
    grade by default); from one half a document is selected. Null and empty
    texts are scored by their missing features; repeated rows each; texts of
    any length whole; an empty table gives no rows. Columns of ``keep`` that
    have the name of a result give way to it. Without a model everything is
    selected, with nulls.
    """
    keep = tuple(c for c in keep if c not in ("expected_grade", "tail_probability", "selected"))
    own = () if text in keep else (F.col(text).alias("graded_text"),)
    src = docs.select(*keep, *own)
    column, n = (len(keep) if own else keep.index(text)), len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])
    if model is None:
        return src.select(*keep, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    at = next((i for i, g in enumerate(model.grades[1:]) if least is not None and g >= least), 0)
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, column):
            tails, expected = held.value.predict(b.column(column).to_pylist())
            p = tails[:, at]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(expected), pa.array(p), pa.array(p >= 0.5)], names=[*keep, "expected_grade", "tail_probability", "selected"])

    return src.mapInArrow(run, f"{fields}, expected_grade double, tail_probability double, selected boolean")
