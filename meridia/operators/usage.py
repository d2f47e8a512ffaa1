"""Usage of model spans, per trace."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import seconds_between
from ..plans.schemas import SPAN
from .ancestry import climb

LEAVES = ("generation", "response")


def tokens(usage: str = "usage", response: str = "response") -> tuple[Column, Column, Column]:
    """(input, output, total): names old or new, own usage before the response's, a missing total is their sum."""
    own = lambda k: F.try_element_at(F.col(usage), F.lit(k))
    has = F.coalesce(F.size(usage) > 0, F.lit(False))
    got = F.when(has, F.coalesce(own("input_tokens"), own("prompt_tokens"), F.lit(0))).otherwise(F.coalesce(F.col(f"{response}.usage.input_tokens"), F.lit(0)))
    made = F.when(has, F.coalesce(own("output_tokens"), own("completion_tokens"), F.lit(0))).otherwise(F.coalesce(F.col(f"{response}.usage.output_tokens"), F.lit(0)))
    total = F.when(has, own("total_tokens")).otherwise(F.col(f"{response}.usage.total_tokens"))
    return got, made, F.coalesce(F.nullif(total, F.lit(0)), got + made)


def steps(spans: DataFrame) -> DataFrame:
    """One row per model span, with its tokens and duration; other spans are only containers."""
    got, made, total = tokens()
    start, end = F.col("started_at").try_cast("timestamp"), F.col("ended_at").try_cast("timestamp")
    return spans.where(F.col("type").isin(*LEAVES)).select(
        "trace_id", "span_id", "parent_id", F.coalesce("model", "response.model").alias("model"), got.alias("input_tokens"), made.alias("output_tokens"), total.alias("total_tokens"),
        start.alias("started_at"), end.alias("ended_at"), seconds_between(start, end).alias("duration_seconds"),
    )


def in_order(steps: DataFrame) -> DataFrame:
    """Steps by their start, those without one first; ties by span."""
    return steps.orderBy(F.col("started_at").asc_nulls_first(), "span_id")


class SpanCollector:
    """Collects spans of a scope on the driver, as a table of the schema SPAN; spans end when their scope does, with or without an error."""

    def __init__(self, trace_id: str):
        self.trace_id, self.rows, self.open = trace_id, [], []

    @contextmanager
    def span(self, kind: str, name: str, model: str | None = None) -> Iterator[dict]:
        """A span below the innermost open one; what the caller puts into the yielded dict under ``usage`` is kept."""
        row = {"span_id": f"{self.trace_id}-{len(self.rows)}", "parent_id": self.open[-1] if self.open else None, "trace_id": self.trace_id, "type": kind, "name": name, "model": model, "usage": {}, "response": None}
        self.rows.append(row)
        self.open.append(row["span_id"])
        row["started_at"] = datetime.now(timezone.utc).isoformat()
        try:
            yield row
        finally:
            row["ended_at"] = datetime.now(timezone.utc).isoformat()
            self.open.pop()

    def spans(self, spark: SparkSession) -> DataFrame:
        """The spans that have ended."""
        done = [tuple(r[f] for f in SPAN.names) for r in self.rows if "ended_at" in r]
        return spark.createDataFrame(done, SPAN)


def roll_up(steps: DataFrame) -> DataFrame:
    """Per trace: sums, requests, wall_seconds from first start to last end, busy_seconds."""
    return steps.groupBy("trace_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("requests"),
        seconds_between(F.min("started_at"), F.max("ended_at")).alias("wall_seconds"), F.round(F.sum("duration_seconds"), 6).alias("busy_seconds"),
    )


def labels(spans: DataFrame) -> DataFrame:
    """(span_id, label) of model spans: the name of the nearest ancestor of type agent, however far; null without one.

    Parents are of the same trace. Spans in a circle have no label.
    """
    agent = F.coalesce(F.col("type") == "agent", F.lit(False))
    met = climb(spans, "trace_id", "span_id", "parent_id", agent)
    names = spans.where(agent).groupBy("trace_id", F.col("span_id").alias("top")).agg(F.min("name").alias("label"))
    found = met.join(names, ["trace_id", "top"]).select("trace_id", "span_id", "label")
    leaves = spans.where(F.col("type").isin(*LEAVES)).select("trace_id", "span_id")
    return leaves.join(found, ["trace_id", "span_id"], "left").select("span_id", "label")
