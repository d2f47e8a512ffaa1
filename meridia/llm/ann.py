"""Approximate nearest neighbours: an inverted file of coarse centroids with
product-quantised residuals, asymmetric distance tables and exact reranking.

Centroids and codebooks are fitted on a bounded sample; every row is encoded.
A query looks into its nearest cells, ranks their codes by distance tables and
reranks the best of each block exactly, on original vectors. Every row keeps the
error of its code, so distance to the code less error is a lower bound: all rows
whose bound does not exceed the k-th exact distance are reranked too, and then
all cells whose nearest possible member is within that distance are looked into.
No true neighbour is cut. Cells are cut into blocks of bounded size; queries go
to the cells by a join, in blocks, and are never all in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace
from .vectors import matrix, sample, usable


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _squares(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def nearest(
    spark: SparkSession,
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    cells: int | None = None,
    probes: int | None = None,
    parts: int = 16,
    codes: int = 64,
    shortlist: int = 100,
    block: int = 20_000,
    turn_rows: int = 50_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of all other rows by Euclidean distance.

    Nearest first, ties to the smaller id. Null, zero or non-finite vectors,
    null ids and vectors of another dimension than most take no part; repeated
    rows of one id are candidates each, but not for that id itself, and of a
    query's rows the smallest vector asks. The result
    is exact: cells, probes, shortlist and codes only change what it costs. A
    query whose cells hold fewer than k candidates looks into all cells. An
    empty table gives no rows; other columns are ignored.

    There are as many cells as a quarter of the root of the rows, 64 at least and
    1024 at most, fitted on 32 vectors a cell or 8192; an eighth of them are
    probed first, which gives each query its bound.
    """
    ws = Workspace(spark, "ann")
    v = F.transform(vector, lambda x: x.cast("double"))
    data = rows.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query"))
    cells = cells or max(64, min(1024, int(data.count() ** 0.5) // 4))
    fit = sample(data, "v", max(8192, 32 * cells))
    dims = [len(x) for x in fit]
    dim = max(set(dims), key=dims.count) if dims else 1
    x = np.array([f for f in fit if len(f) == dim]).reshape(-1, dim)
    coarse = kmeans(x, cells) if len(x) else np.zeros((1, dim))
    cuts = np.array_split(np.arange(dim), min(parts, dim))
    rest = x - coarse[_squares(x, coarse).argmin(1)] if len(x) else x
    books = [kmeans(rest[:, c], codes) if len(x) else np.zeros((1, len(c))) for c in cuts]
    probes = min(probes or max(1, cells // 8), len(coarse))

    def index(batches):
        for b in batches:
            x = matrix(b.column("v"))
            d = _squares(x, coarse)
            cell = d.argmin(1)
            r = x - coarse[cell]
            code = np.stack([_squares(r[:, c], book).argmin(1) for c, book in zip(cuts, books)], 1).astype(np.uint8)
            look = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lost = np.sqrt(sum(((r[:, c] - book[code[:, p]]) ** 2).sum(1) for p, (c, book) in enumerate(zip(cuts, books))))
            far = np.sqrt((r * r).sum(1))
            cols = [b.column("vec_id"), b.column("is_query"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lost), pa.array(far), pa.array(list(look), pa.list_(pa.int32()))], names=["vec_id", "is_query", "v", "cell", "code", "lost", "far", "look"]
            )

    indexed = data.where(F.size("v") == dim).mapInArrow(index, "vec_id long, is_query boolean, v array<double>, cell int, code binary, lost double, far double, look array<int>")
    table = ws.stage(indexed, "index")
    sizes = table.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("far").alias("radius"))  # a row per cell
    sizes = ws.stage(sizes, "sizes")
    radius = np.full(len(coarse), -np.inf)
    for row in sizes.collect():
        radius[row["cell"]] = row["radius"]
    blocks = F.broadcast(sizes.select("cell", "blocks"))
    held = table.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v", "code", "lost")
    asked = table.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("inf")).alias("bound"), "look")
    result = "query_id long, vec_id long, score double"
    out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return out_schema.empty_table()
        centre = coarse[found.column("cell")[0].as_py()]
        ids = found.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], matrix(found.column("v"))[order]
        code = np.frombuffer(b"".join(found.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        lost = found.column("lost").to_numpy()[order]
        out = []
        for q, y, bound in zip(queries.column("query_id").to_numpy(), matrix(queries.column("q")), queries.column("bound").to_numpy()):
            r = y - centre
            approx = np.zeros(len(ids))
            for p, (c, book) in enumerate(zip(cuts, books)):
                approx += ((book - r[c]) ** 2).sum(1)[code[:, p]]
            approx = np.sqrt(approx)
            own = ids == q
            approx[own] = np.inf
            best = np.argpartition(approx, shortlist)[:shortlist] if len(ids) > shortlist else np.arange(len(ids))
            exact = np.sqrt(((x[best] - y) ** 2).sum(1))
            exact[own[best]] = np.inf
            if k <= len(exact):
                bound = min(bound, np.partition(exact, k - 1)[k - 1])
            if len(ids) > shortlist:  # all others that their code's error lets be as near
                slack = 1e-9 * (approx + lost + np.sqrt(y @ y))
                near = (approx - lost - slack <= bound) & ~own
                near[best] = False
                more = np.flatnonzero(near)
                best, exact = np.append(best, more), np.append(exact, np.sqrt(((x[more] - y) ** 2).sum(1)))
            kept = ~own[best] & (exact <= bound)
            best, exact = best[kept], exact[kept]
            top = np.lexsort((ids[best], exact))[:k]
            out.append((np.full(len(top), q), ids[best][top], exact[top]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=out_schema)

    def run(q: DataFrame) -> DataFrame:
        """Hits of the queries in the cells that they look into. A cell that more than turn_rows queries ask is read in several turns, each with a part of them."""
        sent = ws.stage(q.select("query_id", "q", "bound", F.explode("look").alias("cell")), "sent")
        turns = sent.groupBy("cell").agg(F.ceil(F.count("*") / turn_rows).cast("int").alias("turns"))
        turns = F.broadcast(ws.stage(turns, "turns"))  # a row per cell
        sent = sent.join(blocks, "cell").join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
        sent = sent.select("query_id", "q", "bound", F.col("cell").alias("q_cell"), F.col("turn").alias("q_turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"))
        stored = held.join(turns, "cell").select("cell", "block", "vec_id", "v", "code", "lost", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        return sent.groupBy("q_cell", "q_block", "q_turn").cogroup(stored.groupBy("cell", "block", "turn")).applyInArrow(search, result)

    def ranked(hits: DataFrame) -> DataFrame:
        first = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return hits.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= k)

    def rest_of(batches):
        """Cells not looked into whose nearest possible member is within the bound."""
        for b in batches:
            y, bound = matrix(b.column("q")), b.column("bound").to_numpy()
            d = np.stack([np.sqrt(((y - c) ** 2).sum(1)) for c in coarse], 1)
            slack = 1e-9 * (d + np.sqrt((y * y).sum(1))[:, None])
            open_ = d - radius - slack <= bound[:, None]
            for i, seen in enumerate(b.column("look").to_pylist()):
                open_[i, seen] = False
            look = [np.flatnonzero(o).astype(np.int32) for o in open_]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(look, pa.list_(pa.int32()))], names=["query_id", "q", "bound", "look"])

    asked = asked.groupBy("query_id").agg(F.min(F.struct("q", "bound", "look")).alias("first")).select("query_id", "first.*")
    near = ws.stage(ranked(run(asked)), "near").drop("rank")
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("kth"))
    again = asked.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", "bound").alias("bound"), "look")
    again = again.mapInArrow(rest_of, "query_id long, q array<double>, bound double, look array<int>").where(F.size("look") > 0)
    return ranked(near.unionByName(run(again))).select("query_id", "rank", "vec_id", "score")
