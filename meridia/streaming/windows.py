"""Structured Streaming forms of the windowed operators (extensions)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums; a window is final when the watermark has passed it."""
    rows = stream.withWatermark(time, late)
    got = rows.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n", "total")


def distinct_identities(stream: DataFrame, time: str, identity: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([identity])


def upsert_stream(stream: DataFrame, put: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``put``; repeated batches must be idempotent there, as upserts are."""
    return stream.writeStream.foreachBatch(lambda df, _: put(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(stream: DataFrame, time: str, seen: DataFrame, key: str) -> DataFrame:
    """Rows of a batch that came after their window was final, for a side output: earlier than the watermark that ``seen`` (key, final) holds per key.

    A stream drops such rows without a word; inside ``foreachBatch`` this shows them.
    """
    return stream.join(seen, key).where(F.col(time) < F.col("final")).drop("final")


def in_order(stream: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """Rows of each key in the order of their time, each given out once the watermark has passed it, with ``nth`` from 1.

    Rows that are not final wait in the state; a key's state is emptied as the
    watermark advances.
    """
    names = [f.name for f in stream.schema.fields]
    row = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, nth = state.get if state.exists else ([], 0)
        waiting = pd.concat([pd.DataFrame([list(r) for r in held], columns=names), *batches], ignore_index=True) if held else pd.concat(list(batches) or [pd.DataFrame(columns=names)], ignore_index=True)
        final = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        waiting = waiting.sort_values(time, kind="stable")
        done = pd.to_datetime(waiting[time]) < final
        out, rest = waiting[done], waiting[~done]
        if len(rest):
            state.update(([tuple(r) for r in rest.itertuples(index=False)], nth + len(out)))
            state.setTimeoutTimestamp(int(pd.Timestamp(rest[time].min()).timestamp() * 1000) + 1)
        elif state.exists or len(out):
            state.update(([], nth + len(out)))
        yield out.assign(nth=range(nth + 1, nth + len(out) + 1))

    kinds = f"rows array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in stream.schema.fields)}>>, nth long"
    return stream.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, f"{row}, nth long", kinds, "append", GroupStateTimeout.EventTimeTimeout)
