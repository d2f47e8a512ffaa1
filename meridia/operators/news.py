"""Windowed news collection: listing times, coverage, failures, document preparation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..functions.time import ceil_to_hour, parse_news_datetime
from ..sources.html import html_or_text

# fixed values: the listing's zone, its short and full times, the number in an address, and its address
ZONE = "America/New_York"
SHORT = r"(?i)^(\d{1,2}):(\d{2})\s+E(?:S|D)?T$"
FULL = r"(?i)^([A-Za-z]{3})\s+(\d{1,2}),\s+(\d{4}),\s+(\d{1,2}):(\d{2})\s+E(?:S|D)?T$"
PAYLOAD_ID = r"-(\d+)\.html$"
PAGE_SIZE, MAX_PAGES, CACHE_BUSTS = 100, 20, 8


def _utc(local: Column) -> Column:
    return F.to_utc_timestamp(local, ZONE)


def listing_times(
    rows: DataFrame, feed: str | None = None, page: str = "page_number", row: str = "row_number", page_date: str = "page_date", stamp: str = "timestamp_text", pages: int = 10
) -> DataFrame:
    """Adds published_at (UTC) and time_error to listing rows, newest first.

    A short time belongs to the day of the row before it, or the day before
    that if the clock is later than there; the first row, to the page's date. A
    full time starts afresh. Rows that cannot be read change nothing. ``feed``
    names a column whose listings are independent.

    A listing of any length is read in segments of ``pages`` pages, by many
    tasks: what a segment does to the clock (its first and last time, days gone back, last full date)
    is one row, a prefix over these rows gives each segment the clock it begins with, and its rows are set by that.
    """
    group = ([F.col(feed)] if feed else []) + [F.coalesce(F.floor(F.col(page) / pages), F.lit(-1)).alias("_seg")]
    value = text.normalize_space(F.col(stamp))
    short, full = value.rlike(SHORT), value.rlike(FULL)
    month_day = F.concat_ws(" ", F.initcap(F.regexp_extract(value, FULL, 1).substr(1, 3)), F.regexp_extract(value, FULL, 2), F.regexp_extract(value, FULL, 3))
    full_day = F.to_date(F.try_to_timestamp(month_day, F.lit("MMM d yyyy")))
    part = lambda pattern, k: F.regexp_extract(value, pattern, k).cast("int")
    hour, rest = (F.when(short, part(SHORT, k)).when(full, part(FULL, k + 3)) for k in (1, 2))
    readable = (short | (full & full_day.isNotNull())) & (hour < 24) & (rest < 60)
    out = rows.withColumn("_ok", F.coalesce(readable, F.lit(False))).withColumn("_m", F.when(F.col("_ok"), hour * 60 + rest)).withColumn("_full", F.when(F.col("_ok") & full, full_day))
    out = out.withColumn("_seg", group[-1]).withColumn("_feed", F.col(feed).cast("string") if feed else F.lit(""))

    inside = Window.partitionBy("_feed", "_seg").orderBy(page, row)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_last", F.last("_m", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    back = F.when(F.col("_full").isNull() & (F.col("_m") > F.col("_last")), 1).otherwise(0)
    out = out.withColumn("_back", back).withColumn("_run", F.sum(F.col("_full").isNotNull().cast("int")).over(upto)).withColumn("_since", F.last("_full", ignorenulls=True).over(upto))
    out = out.withColumn("_days", F.sum("_back").over(Window.partitionBy("_feed", "_seg", "_run").orderBy(page, row).rowsBetween(Window.unboundedPreceding, 0)))

    at = F.struct(F.col(page), F.col(row))
    moved = out.where("_ok").groupBy("_feed", "_seg").agg(
        F.min_by("_m", at).alias("m0"), F.min_by(F.col("_full").isNotNull(), at).alias("fresh"), F.min_by(F.to_date(page_date), at).alias("date0"),
        F.max_by("_m", at).alias("m1"), F.max_by("_since", at).alias("full1"), F.max_by("_days", at).alias("days1"),
    )
    line = Window.partitionBy("_feed").orderBy("_seg")  # a row for each segment
    before, through = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    moved = moved.withColumn("enter", F.when(~F.col("fresh") & (F.col("m0") > F.lag("m1").over(line)), 1).otherwise(0))
    moved = moved.withColumn("step", F.col("days1") + F.when(F.col("full1").isNull(), F.col("enter")).otherwise(0)).withColumn("run", F.sum(F.col("full1").isNotNull().cast("int")).over(through))
    moved = moved.withColumn("gone", F.sum("step").over(Window.partitionBy("_feed", "run").orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)))
    start = F.coalesce(F.last("full1", ignorenulls=True).over(before), F.first("date0", ignorenulls=True).over(through))
    moved = moved.select("_feed", "_seg", start.alias("_start"), (F.coalesce(F.lag("gone").over(line), F.lit(0)) + F.col("enter")).alias("_gone"))

    out = out.join(moved, (out["_feed"].eqNullSafe(moved["_feed"])) & (out["_seg"] == moved["_seg"]), "left").drop(moved["_feed"]).drop(moved["_seg"])
    days = F.col("_days") + F.when(F.col("_since").isNull(), F.col("_gone")).otherwise(0)
    local = F.date_sub(F.coalesce("_since", "_start"), days.cast("int")).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_m"))
    out = out.withColumn("published_at", F.when(F.col("_ok"), _utc(local))).withColumn("time_error", ~F.col("_ok"))
    return out.select(*rows.columns, "published_at", "time_error")


def in_window(time: Column, start: datetime, end: datetime) -> Column:
    """start <= time < end; both bounds with a zone."""
    for bound in (start, end):
        if bound.tzinfo is None:
            raise ValueError("a window needs bounds with a time zone")
    if end <= start:
        raise ValueError("a window ends after it starts")
    return (time >= F.lit(start)) & (time < F.lit(end))


def coverage(rows: DataFrame, start: Column, time: str = "published_at", error: str | None = "time_error") -> DataFrame:
    """One row: observed, failed, crossed_start, complete. Only a row strictly before the start shows that all of the window was seen."""
    failed = F.coalesce(F.count_if(F.col(error)), F.lit(0)) if error else F.lit(0)
    got = rows.agg(F.count(time).alias("observed"), failed.alias("failed"), F.coalesce(F.bool_or(F.col(time) < start), F.lit(False)).alias("crossed_start"))
    return got.withColumn("complete", F.col("crossed_start") & (F.col("failed") == 0))


def pages_to_read(pages: DataFrame, start: Column, cap: int = MAX_PAGES) -> DataFrame:
    """Pages up to the first that holds a row strictly before the start, or that repeats the page before it, or is empty; at most ``cap``.

    pages: page_number, oldest (its earliest time), fingerprint, n_rows. Adds ``outcome``.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("page_number")  # at most cap rows of a listing
    few = pages.where(F.col("page_number") <= cap)
    stuck = F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order)) & (F.row_number().over(order) > 1)
    outcome = F.when(F.col("n_rows") == 0, "empty").when(stuck, "repeated").when(F.col("oldest") < start, "crossed").when(F.col("page_number") == cap, "cap").otherwise("more")
    seen = few.withColumn("outcome", outcome)
    ended = F.coalesce(F.max((F.col("outcome") != "more").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def fingerprint(rows: DataFrame) -> DataFrame:
    """(page_number, fingerprint, n_rows) of listing pages, by their ordered links and times."""
    ordered = F.array_sort(F.collect_list(F.struct("row_number", "href", "timestamp_text")))
    return rows.groupBy("page_number").agg(F.sha2(F.to_json(ordered), 256).alias("fingerprint"), F.count("*").alias("n_rows"))


def observations(rows: DataFrame, base_url: str) -> DataFrame:
    """Listing rows with title and link as observations; the others get an error."""
    link = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).otherwise(F.concat(F.lit(base_url.rstrip("/")), F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(F.lit("/"), "href"))))
    url = text.canonical_url(link)
    error = F.when(F.coalesce("href", F.lit("")) == "", "no link").when(F.coalesce(text.normalize_space(F.col("title")), F.lit("")) == "", "no title")
    payload = F.nullif(F.regexp_extract(url, PAYLOAD_ID, 1), F.lit(""))
    out = rows.withColumn("error", error).withColumn("canonical_url", F.when(error.isNull(), url)).withColumn("payload_id", F.when(error.isNull(), payload))
    return out.withColumn("identity", F.when(error.isNull(), identity.news_identity(F.lit("press_release"), F.col("payload_id"), F.col("canonical_url"))))


def error_class(kind: Column) -> Column:
    """Class of a failure by the name of what was raised."""
    exhausted, timeout, network, status, content = "attempts_exhausted", "timeout", "transport", "http_status", "value"
    return (
        F.when(kind == exhausted, "retry_exhausted").when(kind == timeout, "timeout").when(kind == network, "network").when(kind == status, "http_status").when(kind == content, "invalid_content").otherwise("unexpected")
    )


def prepare(raw: DataFrame) -> DataFrame:
    """Raw news documents as candidates, with ``error`` where there is no body or identity.

    In: body_text, source_type, source_url, title, publisher, published_at,
    payload_id, metadata, and error where something failed before. Empty metadata values are dropped; times as text are
    parsed; the title takes part in the search for tickers.
    """
    had = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    raw = raw.withColumn("_error", had).withColumn("body_text", F.coalesce("body_text", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))
    raw = text.with_news_text(text.with_news_text(raw, "body_text"), "title")
    out = raw.withColumn("title", F.nullif("title", F.lit("")))
    out = out.withColumn("identity", identity.news_identity(F.col("source_type"), F.col("payload_id"), F.col("source_url")))
    empty = F.when(F.col("body_text") == "", "empty body").when(F.col("identity").isNull(), "no identity")
    out = out.withColumn("error", F.coalesce("_error", empty)).drop("_error")
    if dict(raw.dtypes)["published_at"] == "string":
        out = out.withColumn("published_at", parse_news_datetime(F.col("published_at")))
    return (
        out.withColumn("content_hash", text.content_hash(F.col("body_text")))
        .withColumn("source_url", text.canonical_url(F.col("source_url")))
        .withColumn("ticker_hints", text.ticker_hints(F.concat_ws("\n", "title", "body_text")))
        .withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull() & (v != "")))
    )


def split_outcomes(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failures); a failure is never also a document."""
    return prepared.where("error is null").drop("error"), prepared.where("error is not null").select("identity", "source_url", F.lit("preprocess").alias("stage"), F.lit("invalid_content").alias("error_type"), F.col("error").alias("message"))


def feed_documents(items: DataFrame, publisher: str | None = None, source_type: str = "press_release", article: bool = False) -> DataFrame:
    """Feed items as raw news documents: the text of the content, or else of the summary.

    With ``article`` the body is left to be fetched from the item's address; an
    item without one has an error.
    """
    html = F.coalesce(F.nullif("content_html", F.lit("")), "summary_html", F.lit(""))
    own = {"body_source": F.lit("article" if article else "feed"), "source_feed_url": F.col("feed_url")}
    extra = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    raw = F.coalesce("raw", F.create_map().cast("map<string,string>"))
    return items.select(
        (F.lit(None).cast("string") if article else html_or_text(html)).alias("body_text"),
        F.lit(source_type).alias("source_type"),
        F.col("url").alias("source_url"),
        "title",
        F.lit(publisher).cast("string").alias("publisher"),
        "published_at",
        F.col("id").alias("payload_id"),
        F.map_concat(F.map_filter(extra, lambda k, _: ~F.map_contains_key(raw, k)), raw).alias("metadata"),
        F.when(F.lit(article) & (F.coalesce("url", F.lit("")) == ""), "an article needs an address").alias("error"),
    )


def listing_url(base: str, anchor: Column, page: Column, bust: Column | None = None) -> Column:
    """Address of a listing page: the hour that the window ends in, in the listing's zone, and a number that defeats caches."""
    local = F.from_utc_timestamp(ceil_to_hour(anchor), ZONE)
    part = lambda name, c: F.concat(F.lit(f"&{name}="), c.cast("string"))
    url = F.concat(
        F.lit(f"{base}?page="), page.cast("string"), F.lit(f"&pagesize={PAGE_SIZE}"),
        part("month", F.month(local)), part("day", F.dayofmonth(local)), part("year", F.year(local)), F.lit("&hour="), F.date_format(local, "HH"),
    )
    return url if bust is None else F.concat(url, F.lit("&_="), bust.cast("string"))
