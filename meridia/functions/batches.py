"""Batches for Python workers, bounded in bytes and not in rows alone."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = 2 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Batches for Python workers hold at most BATCH bytes (or one row), unless the session sets less; rows may be large."""
    spark = spark or SparkSession.active()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", spark.conf.get(key)).group()) > BATCH:
        spark.conf.set(key, str(BATCH))


def released() -> None:
    """Gives the memory of batches that are done back to the system."""
    pa.default_memory_pool().release_unused()
