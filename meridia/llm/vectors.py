"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one dimension, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(df: DataFrame, vector: str, rows: int) -> list[np.ndarray]:
    """At most ``rows`` vectors, those of smallest hash, so the same ones on every run; one dimension each entry."""
    got = df.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(rows).collect()
    return [np.array(r["v"]) for r in got]
