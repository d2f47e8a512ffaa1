"""Local and object-store files as rows of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_type


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content_type, body, modified_at, content_hash); a missing path is an error."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", content_type(F.col("path")).alias("content_type"), F.col("content").alias("body"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"))


def text_of(fetched: DataFrame, body: str = "body", kind: str = "content_type") -> DataFrame:
    """Adds ``text`` and ``error``: HTML to text, plain and XML as they are, anything else refused."""
    from .html import html_text

    decoded = F.decode(F.col(body), "UTF-8")
    ct = F.lower(F.coalesce(F.col(kind), F.lit("")))
    html = ct.startswith("text/html") | ct.startswith("application/xhtml+xml")
    plain = ct.startswith("text/plain") | ct.startswith("text/markdown") | ct.startswith("application/xml") | ct.startswith("text/xml")
    out = fetched.withColumn("text", F.when(html, html_text(F.when(html, decoded))).when(plain, decoded))
    return out.withColumn("error", F.when(~(html | plain), F.concat(F.lit("unsupported content type "), ct)))


def register_assets(assets: DataFrame) -> DataFrame:
    """Blobs with content hash and size, one row per content of a source, kind and page."""
    from ..functions.identity import asset_id

    out = assets.withColumn("content_hash", F.sha2("blob", 256)).withColumn("size_bytes", F.length("blob").cast("long"))
    out = out.withColumn("asset_id", asset_id(F.col("source_revision_id"), F.col("kind"), F.col("page_number"), F.col("content_hash")))
    return out.dropDuplicates(["asset_id"])
