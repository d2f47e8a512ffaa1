"""What runs did, as rows of a table: counts, failures, times, errors.

Counts are metrics that Spark gathers while the run's own action passes over the
rows, so nothing is read for them a second time. A run of a batch and each
micro-batch of a stream is one row.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.schemas import ddl

RUN = ddl("run string, started_at timestamp, seconds double, metrics map<string,bigint>, error string")


def outcome_counts() -> dict[str, Column]:
    """total, success and failure of results (idx, result, error)."""
    return {"total": F.count(F.lit(1)), "success": F.count("result"), "failure": F.count("error")}


class Run:
    """One run: what is watched in it, and what its hooks are told."""

    def __init__(self, name: str):
        self.name, self.metrics, self._watched = name, {}, []

    def watch(self, df: DataFrame, prefix: str = "", **metrics: Column) -> DataFrame:
        """The same rows; the metrics (aggregates that give whole numbers) are gathered when they pass."""
        seen = Observation()
        self._watched.append((prefix, seen))
        return df.observe(seen, *[c.alias(k) for k, c in metrics.items()])

    def _gather(self, spark: SparkSession) -> None:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)  # metrics come after their action
        for prefix, seen in self._watched:
            if seen._jo is not None and seen._jo.future().isCompleted():  # rows that no action has passed have none
                self.metrics |= {prefix + k: int(v) for k, v in seen.get.items() if v is not None}


class RunLog:
    """A table of runs in a folder. Hooks are called in order with each row; what one raises ends the run."""

    def __init__(self, spark: SparkSession, root: str, hooks: tuple[Callable[[dict], None], ...] = ()):
        self.spark, self.path, self.hooks = spark, f"{root.rstrip('/')}/runs", hooks

    def _write(self, row: dict) -> None:
        self.spark.createDataFrame([tuple(row[f.name] for f in RUN)], RUN).write.mode("append").parquet(self.path)
        for hook in self.hooks:
            hook(row)

    @contextmanager
    def run(self, name: str) -> Iterator[Run]:
        """A run from here to the end of the block, also one that raises."""
        run, begun, at, error = Run(name), datetime.now(timezone.utc), time.monotonic(), None
        try:
            yield run
        except Exception as exc:
            error = f"{type(exc).__name__}: {exc}".splitlines()[0]
            raise
        finally:
            run._gather(self.spark)
            self._write({"run": name, "started_at": begun, "seconds": time.monotonic() - at, "metrics": run.metrics, "error": error})

    def listener(self) -> StreamingQueryListener:
        """For ``spark.streams.addListener``: a row for each micro-batch of named streams, with its rows and what ``observe`` gathered, and one for a stream that failed."""
        log = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                p = event.progress
                if p.name:
                    metrics = {"batch": p.batchId, "rows": p.numInputRows}
                    for name, row in p.observedMetrics.items():
                        metrics |= {f"{name}.{k}": int(v) for k, v in row.asDict().items() if v is not None}
                    begun = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
                    log._write({"run": p.name, "started_at": begun, "seconds": p.batchDuration / 1000, "metrics": metrics, "error": None})

            def onQueryTerminated(self, event) -> None:
                if event.exception:
                    log._write({"run": str(event.id), "started_at": datetime.now(timezone.utc), "seconds": 0.0, "metrics": {}, "error": event.exception.splitlines()[0]})

        return Listener()

    def table(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.path)


def shown(row: dict) -> str:
    """A row as one line of JSON, for a log."""
    return json.dumps(row, default=str, sort_keys=True)
