"""Fan-out of a function over inputs with per-row errors, and its counts."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_run(inputs: DataFrame, flow: Callable[[dict], str | None], on_error: str = "skip", concurrency: int | None = None) -> DataFrame:
    """(idx, result, error) per input row; inputs have idx. A result is text or None; on_error "raise" fails the job at the first error."""
    if on_error not in ("skip", "raise"):
        raise ValueError("on_error is skip or raise")
    if concurrency is not None and concurrency < 1:
        raise ValueError("concurrency must be at least 1")
    columns = [c for c in inputs.columns if c != "idx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append((row["idx"], flow({c: row[c] for c in columns}), None))
                except Exception as exc:
                    if on_error == "raise":
                        raise
                    out.append((row["idx"], None, "".join(traceback.format_exception_only(exc)).strip()))
            yield pd.DataFrame(out, columns=["idx", "result", "error"])

    spread = inputs.repartition(concurrency, "idx") if concurrency else inputs
    return spread.mapInPandas(run, "idx long, result string, error string")


def counts(results: DataFrame) -> DataFrame:
    """total, success (results that are not null) and failure (errors); a null result without error is neither."""
    return results.agg(F.count("*").alias("total"), F.count("result").alias("success"), F.count("error").alias("failure"))


def errors(results: DataFrame) -> DataFrame:
    return results.where("error is not null").select("idx", "error").orderBy("idx")
