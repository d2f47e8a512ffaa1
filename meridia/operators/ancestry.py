"""Chains of parents in a logarithmic number of joins.

Every node knows an ancestor; in each round it takes over what that ancestor
knows, so the distance doubles, and a chain of n nodes takes log2(n) rounds. There
is no cap on depth. What still climbs when more has been jumped than a
chain can have goes round in a circle.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session that the driver and all executors share; a local one only for a local master without any."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/meridia-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows by themselves, in reliable files, without what led to them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder; what led to them runs once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is as large as the table: never broadcast, however well its shuffled files are compressed."""
    return df.hint("merge")


def _open(state: DataFrame) -> bool:
    return state.where(~F.col("ended")).limit(1).count() > 0


def climb(nodes: DataFrame, group: str, node: str, up: str, stop: Column) -> DataFrame:
    """(group, node, top, steps): the nearest node at which ``stop`` holds, from the node itself upwards.

    Nodes whose chain ends elsewhere, at an unknown parent or in a circle, have
    no row. Of rows that share an id the one with the smallest parent counts.
    """
    one = nodes.groupBy(group, node).agg(F.min(F.struct(F.col(up).alias("up"), stop.alias("stop"))).alias("x")).select(group, node, "x.up", "x.stop")
    first = one.select(group, node, F.when(F.col("stop"), F.col(node)).otherwise(F.col("up")).alias("top"), F.when(F.col("stop"), 0).otherwise(1).cast("long").alias("steps"), F.col("stop").alias("ended"))
    state = cut(first.where("top is not null"))
    most = state.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    jumped = 1
    while jumped <= 2 * most and _open(state):
        above = state.select(group, F.col(node).alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
        moved = state.where(~F.col("ended")).join(shuffled(above), [group, "top"]).select(group, node, F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"))
        state = cut(state.where("ended").unionByName(moved))
        jumped *= 2
    return state.where("ended").select(group, node, "top", "steps")


def gathered(nodes: DataFrame, group: str, node: str, up: str, values: list[str]) -> DataFrame:
    """(group, node, and an array for each of ``values``): what is met from the root, which has no parent, down to the node. Nodes that reach no root have no row."""
    depth = climb(nodes, group, node, up, F.col(up).isNull())
    one = nodes.groupBy(group, node).agg(F.min(F.struct(F.col(up).alias("_up"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])).alias("x")).select(group, node, "x.*")
    lists = [f"_l{i}" for i in range(len(values))]
    first = one.join(shuffled(depth.select(group, node)), [group, node]).select(group, node, F.col("_up").alias("top"), F.col("_up").isNull().alias("ended"), *[F.array(f"_v{i}").alias(x) for i, x in enumerate(lists)])
    state = cut(first)
    while _open(state):
        above = state.select(group, F.col(node).alias("top"), F.col("top").alias("_top"), F.col("ended").alias("_ended"), *[F.col(x).alias(f"_{x}") for x in lists])
        moved = state.where(~F.col("ended")).join(shuffled(above), [group, "top"]).select(group, node, F.col("_top").alias("top"), F.col("_ended").alias("ended"), *[F.concat(f"_{x}", x).alias(x) for x in lists])
        state = cut(state.where("ended").unionByName(moved))
    return state.select(group, node, *[F.col(x).alias(v) for x, v in zip(lists, values)])
