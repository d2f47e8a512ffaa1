"""Helpers shared by the training-data operators: lineage cuts, table input and
connected components.

Intermediate tables are written as Parquet under the folder that the session
names in ``spark.checkpoint.dir`` (shared by the driver and all executors), so
a lost executor costs a re-read and never the table.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, SLICE = 8 << 20, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Batches for Python workers hold at most BATCH bytes (or one row), unless the session sets less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", spark.conf.get(key)).group()) > BATCH:
        spark.conf.set(key, str(BATCH))


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have at most ``limit`` bytes together, or are one text; what a part took is given back."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at, done = stop, ends[stop - 1]
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a local one, which only a local master's tasks can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/meridia-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_OPEN: list["Workspace"] = []


def clean(spark: SparkSession) -> None:
    """Deletes all tables that operators have staged in this process; call it when their results are written."""
    while _OPEN:
        _OPEN.pop().delete(spark)


class Workspace:
    """Writes intermediate tables of one operator run and rereads them.

    Results read them, so they stay until ``clean`` is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        bounded(spark)
        _OPEN.append(self)

    def delete(self, spark: SparkSession) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._meridia_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that nothing will read again."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if path := getattr(df, "_meridia_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def connected_components(ws: Workspace, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that an edge (a, b) touches; component is
    the smallest node reachable.

    Alternating large-star and small-star rounds. Each round's minimum per node
    is pre-aggregated before its shuffle and written before it is joined, so
    both join sides come from plain exchanges and adaptive execution can split
    the partition of a hub that a third of all edges touch. Self loops, null
    ends and repeated edges are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        return (
            df.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .groupBy("a", "b")
            .agg(F.lit(1).alias("one"))
            .drop("one")
        )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = ws.stage(clean(edges), "edges")
    seen = mark(now)
    files = seen[0] // 250_000 + 4  # no more than that many rows each; the number of edges never grows

    def stage(df: DataFrame, name: str) -> DataFrame:
        return ws.stage(df.coalesce(files), name)

    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "min")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = stage(clean(large), "large")
        least = stage(star.groupBy("a").agg(F.min("b").alias("m")), "min")
        small = star.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stage(clean(small.unionByName(least.select("a", F.col("m").alias("b")))), "small")
        state = mark(new)
        ws.drop(now, low, star, least)
        now, same = new, state == seen
        seen = state
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
