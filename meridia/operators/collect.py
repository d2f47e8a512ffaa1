"""News of a window from a paginated listing: discovery, articles, outcomes."""

from __future__ import annotations

import time as clock
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import ddl
from ..sources.feeds import parse_listing
from ..sources.html import html_text
from ..sources.http import FetchPolicy, fetch, fetch_one, send
from . import news
from .ancestry import staged

LISTING_URL = "https://www.prnewswire.com/news-releases/news-releases-list/"  # fixed value: where the listing is
SOURCE, PUBLISHER = "press_release", "PR Newswire"  # fixed values
POLICY = FetchPolicy(attempts=3, base_delay=0.5, max_delay=5.0, jitter=0.1, spacing=0.1, max_bytes=10_000_000)
PAGE = ddl("page_number int, url string, html string, fallback_date date, error_type string, message string")
FAILURE = ("stage", "source_url", "item_id", "error_type", "message")


@dataclass
class NewsBatch:
    """Documents and failures of a window. It is complete if a row before the window was seen and discovery had no failure; articles that fail do not change that."""

    documents: DataFrame
    failures: DataFrame
    observed_count: int
    complete: bool


def fetch_page(url: str, policy: FetchPolicy, transport: Callable, sleep: Callable, tries: int = news.CACHE_BUSTS) -> dict:
    """One listing page; an answer of 404 is asked again with another number in the address."""
    for _ in range(tries):
        row = fetch_one(f"{url}&_={clock.time_ns()}", policy, transport, sleep)
        if row["status"] != 404:
            break
    return row


def discover(spark: SparkSession, start: datetime, end: datetime, transport: Callable = send, policy: FetchPolicy = POLICY, sleep: Callable = clock.sleep, cap: int = news.MAX_PAGES) -> tuple[DataFrame, DataFrame, bool]:
    """(observations in the window, failures, complete), from pages up to the first that has a row before the window.

    The loop is on the driver: whether page n + 1 is asked for depends on page
    n, and there are at most ``cap`` pages of 100 rows. What is read of them is
    one table, and times and observations are found in it.
    """
    news.in_window(F.lit(None), start, end)  # checks the bounds
    anchor = spark.range(1).select(F.lit(end).alias("end"))
    url = news.listing_url(LISTING_URL, F.col("end"), F.lit("{page}"))
    base, day = anchor.select(url, F.to_date(F.from_utc_timestamp(news.ceil_to_hour(F.col("end")), news.ZONE))).first()
    listed, failures, seen, crossed = [], [], None, False
    rows = spark.createDataFrame([], ROW)
    for page in range(1, cap + 1):
        address = base.replace("{page}", str(page))
        got = fetch_page(address, policy, transport, sleep)
        if got["error_type"]:
            failures.append(("discovery_fetch", address, None, got["error_type"], got["message"]))
            break
        source = got["resolved_url"] or address
        try:
            written, found = parse_listing(got["body"].decode("utf-8"))
            page_date = datetime.strptime(written, "%m/%d/%Y").date() if written else day
        except ValueError as exc:
            failures.append(("discovery_parse", source, None, "value", str(exc)))
            break
        print_of = [(r["href"], r["timestamp_text"]) for r in found]
        if not found or print_of == seen:
            failures.append(("discovery_parse", source, None, "value", "the listing did not advance" if found else "the listing has no rows"))
            break
        seen = print_of
        listed += [(page, n, page_date, r["href"], r["title"], r["timestamp_text"], r["raw_html"], source) for n, r in enumerate(found)]
        rows = news.listing_times(spark.createDataFrame(listed, ROW))
        if rows.where(F.col("published_at") < F.lit(start)).limit(1).count():
            crossed = True
            break
    else:
        failures.append(("discovery_parse", LISTING_URL, None, "value", f"more than {cap} pages"))
    if not listed:
        rows = rows.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("time_error", F.lit(False))
    found = news.observations(rows, "https://www.prnewswire.com")
    wrong = F.coalesce(F.when(F.col("time_error"), "the time cannot be read"), F.col("error"))
    bad = found.where(wrong.isNotNull()).select(F.lit("discovery_parse").alias("stage"), F.col("page_url").alias("source_url"), F.col("href").alias("item_id"), F.lit("value").alias("error_type"), wrong.alias("message"))
    lost = spark.createDataFrame(failures, FAILURES).unionByName(bad).withColumn("error_type", news.error_class(F.col("error_type")))
    held = found.where(wrong.isNull()).where(news.in_window(F.col("published_at"), start, end))
    return held, lost, crossed and lost.limit(1).count() == 0


ROW = ddl("page_number int, row_number int, page_date date, href string, title string, timestamp_text string, raw_html string, page_url string")
FAILURES = ddl("stage string, source_url string, item_id string, error_type string, message string")


def collect_news(spark: SparkSession, start: datetime, end: datetime, transport: Callable = send, policy: FetchPolicy = POLICY, sleep: Callable = clock.sleep, retain_raw_html: bool = False) -> NewsBatch:
    """The news of ``[start, end)``: each observed release is fetched, cleaned and identified by itself, and fails by itself."""
    seen, lost, complete = discover(spark, start, end, transport, policy, sleep)
    seen = staged(seen, "observed")
    pages = staged(fetch(seen.select(F.col("canonical_url").alias("url")).distinct(), policy, "url", transport), "articles")  # written by the tasks that fetch; not fetched again
    both = seen.join(pages, seen["canonical_url"] == pages["url"])
    failed = both.where(F.col("error_type").isNotNull()).select(F.lit("article_fetch").alias("stage"), F.col("canonical_url").alias("source_url"), F.col("payload_id").alias("item_id"), news.error_class(F.col("error_type")).alias("error_type"), "message")
    body = F.decode(F.col("body"), "UTF-8")
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    html = kind.startswith("text/html") | kind.startswith("application/xhtml+xml")
    raw = both.where(F.col("error_type").isNull()).select(
        F.when(html, html_text(F.when(html, body))).when(kind.startswith("text/"), body).alias("body_text"),
        F.lit(SOURCE).alias("source_type"), F.coalesce("resolved_url", "canonical_url").alias("source_url"), "title", F.lit(PUBLISHER).alias("publisher"), "published_at", "payload_id",
        F.create_map(F.lit("content_type"), kind).alias("metadata"), F.col("identity").alias("listed_identity"), "canonical_url", F.col("raw_html").alias("listing_html"),
        (F.col("body") if retain_raw_html else F.lit(None).cast("binary")).alias("article_html"), F.sha2("body", 256).alias("article_hash"), F.col("status").alias("status_code"), "fetched_at",
    )
    ready = news.prepare(raw).withColumn("identity", F.col("listed_identity")).drop("listed_identity")
    fine = ready.where("error is null").drop("error")
    broken = ready.where("error is not null").select(F.lit("article_parse").alias("stage"), F.col("canonical_url").alias("source_url"), F.col("payload_id").alias("item_id"), F.lit("invalid_content").alias("error_type"), F.col("error").alias("message"))
    return NewsBatch(fine, lost.unionByName(failed).unionByName(broken), seen.count(), complete)
