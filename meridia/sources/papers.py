"""Paper metadata: arXiv entries and DOI records as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text, time
from ..functions.time import partial_date
from ..operators.ancestry import staged
from .http import FetchPolicy, fetch, send

RECORD = (
    "struct<message:struct<DOI:string,title:array<string>,`container-title`:array<string>,publisher:string,type:string,URL:string,"
    "author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>>>"
)


def doi_requests(dois: DataFrame, column: str = "doi", base: str = "https://api.crossref.org/works/") -> DataFrame:
    """Identifiers with the address of their record; null for what is no identifier."""
    clean = text.doi(F.col(column))
    return dois.withColumn("doi", clean).withColumn("url", F.when(clean.isNotNull(), F.concat(F.lit(base), F.url_encode(clean))))


def doi_metadata(fetched: DataFrame, body: str = "body") -> DataFrame:
    """Metadata from record responses: first title and container, formatted authors, date with missing parts as the first."""
    m = F.from_json(F.decode(F.col(body), "UTF-8"), RECORD)["message"]
    parts = F.get(m["published"]["date-parts"], F.lit(0))
    day = partial_date(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    return fetched.select(
        m["DOI"].alias("doi"), F.get(m["title"], F.lit(0)).alias("title"), F.get(m["container-title"], F.lit(0)).alias("container"), m["publisher"].alias("publisher"), text.authors(m["author"]).alias("authors"), day.alias("published"), m["URL"].alias("url"),
    )


def arxiv_requests(ids: DataFrame, column: str = "id", base: str = "https://export.arxiv.org") -> DataFrame:
    """Identifiers with the addresses of their metadata and PDF."""
    clean = text.arxiv_id(F.col(column))
    return ids.withColumn("arxiv_id", clean).withColumn("metadata_url", F.concat(F.lit(f"{base}/api/query?id_list="), clean)).withColumn("pdf_url", F.concat(F.lit(f"{base}/pdf/"), clean))


ATOM = (
    "struct<entry:array<struct<id:string,title:string,summary:string,published:string,updated:string,author:array<struct<name:string>>,"
    "link:array<struct<_href:string,_title:string,_type:string>>,primary_category:struct<_term:string>,category:array<struct<_term:string>>>>>"
)


def arxiv_records(fetched: DataFrame, body: str = "body", url: str = "url") -> DataFrame:
    """(url, arxiv_id, title, authors, abstract, published_at, updated_at, primary_category, categories, pdf_url, error) of metadata answers, by Spark's own XML reader.

    An answer without a record, one that is no XML, and a record without an
    address of its PDF are rows with an error.
    """
    feed = F.from_xml(F.decode(F.col(body), "UTF-8"), ATOM, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    rows = fetched.select(F.col(url).alias("url"), F.get(feed["entry"], F.lit(0)).alias("e"))
    e = F.col("e")
    short = F.regexp_extract(e["id"], r"/abs/(.+?)\s*\z", 1)
    pdf = F.get(F.filter(e["link"], lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), F.lit(0))["_href"]
    found = e.isNotNull() & (short != "")
    line = lambda c: text.normalize_space(c)
    at = lambda c: time.to_utc(F.try_to_timestamp(c))
    error = F.when(~F.coalesce(found, F.lit(False)), "no record").when(F.coalesce(pdf, F.lit("")) == "", "no address of a PDF")
    return rows.select(
        "url", F.when(found, short).alias("arxiv_id"), line(e["title"]).alias("title"), F.transform(e["author"], lambda a: line(a["name"])).alias("authors"), F.trim(e["summary"]).alias("abstract"),
        at(e["published"]).alias("published_at"), at(e["updated"]).alias("updated_at"), e["primary_category"]["_term"].alias("primary_category"), F.transform(e["category"], lambda c: c["_term"]).alias("categories"), pdf.alias("pdf_url"), error.alias("error"),
    )


def arxiv_papers(ids: DataFrame, column: str = "id", policy: FetchPolicy | None = None, transport: Callable = send, base: str = "https://export.arxiv.org") -> DataFrame:
    """Papers by what names them: the record and the PDF of each, or ``error`` with the step that failed.

    Columns: the input's, arxiv_id (with its version), the record's, and of the
    PDF body, content_type, resolved_uri, fetched_at. Answers are written by the tasks that
    fetch them, so nothing is asked for twice.
    """
    asked = arxiv_requests(ids, column, base).drop("pdf_url")
    meta = staged(fetch(asked.where("metadata_url is not null").select("metadata_url").distinct(), policy, "metadata_url", transport), "records")
    records = arxiv_records(meta.where("error_type is null")).unionByName(meta.where("error_type is not null").select("url", F.concat(F.lit("record: "), "message").alias("error")), allowMissingColumns=True)
    held = asked.withColumnRenamed("arxiv_id", "_asked").join(records.withColumnRenamed("url", "metadata_url"), "metadata_url", "left")
    pdfs = staged(fetch(records.where("error is null").select("pdf_url").distinct(), policy, "pdf_url", transport), "papers")
    files = pdfs.select(F.col("url").alias("pdf_url"), "body", "content_type", F.col("resolved_url").alias("resolved_uri"), "fetched_at", F.when(F.col("error_type").isNotNull(), F.concat(F.lit("PDF: "), "message")).alias("_lost"))
    out = held.join(files, "pdf_url", "left")
    error = F.when(F.col("_asked").isNull(), "no identifier").otherwise(F.coalesce("error", "_lost"))
    return out.withColumn("error", error).drop("_asked", "_lost", "metadata_url")


def availability(df: DataFrame) -> DataFrame:
    """Adds available_at: when updated, else when published, else when fetched."""
    return df.withColumn("available_at", F.coalesce("updated_at", "published_at", "fetched_at"))


def acquire(sources: DataFrame) -> DataFrame:
    """Source revisions of fetched papers, or why one is refused, in ``error``.

    In: kind (arxiv, http, local, text, doi), uri, resolved_uri, content_type,
    body, fetched_at, published_at, updated_at, arxiv_id, title, authors. Only
    documents with pages are taken; plain text has none, and a record number
    names no open document. An arXiv paper was available when it was updated, or
    else published; anything else when it was fetched.
    """
    kind, media = F.col("kind"), F.lower(F.coalesce("content_type", F.lit("")))
    error = (
        F.when(kind == "doi", "a record number needs a resolver of open documents")
        .when(kind == "text", "text has no pages")
        .when(~kind.isin("arxiv", "http", "local"), F.concat(F.lit("unknown kind "), kind))
        .when(~media.startswith("application/pdf"), F.concat(F.lit("not a document with pages: "), media))
        .when(F.coalesce("resolved_uri", "uri").isNull(), "no address")
    )
    fetched = time.aware_or_now(F.col("fetched_at"))
    available = F.when(kind == "arxiv", F.coalesce(time.to_utc(F.col("updated_at")), time.to_utc(F.col("published_at")), fetched)).otherwise(fetched)
    content = F.sha2("body", 256)
    return sources.select(
        F.when(error.isNull(), identity.source_id(content)).alias("source_revision_id"), content.alias("content_hash"), "kind", F.coalesce("resolved_uri", "uri").alias("uri"),
        fetched.alias("as_of"), available.alias("available_at"), "published_at", "arxiv_id", "title", "authors", error.alias("error"),
    )
