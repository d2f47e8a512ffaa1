"""Registered queries over feeds, listings and news documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time
from ..operators import batch, news
from ..sources import feeds, files
from .registry import registered, t


def _item(tag: str, *fields):
    """An element with the given (name, column) children."""
    parts = [x for name, c in fields for x in (F.lit(f"<{name}>"), c, F.lit(f"</{name.split(' ')[0]}>"))]
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))


@registered("""
SELECT 'u' || p_brand AS feed_url, 'T ' || p_brand AS feed_title, p_name AS title, 'http://x/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'g' || p_partkey ELSE 'http://x/' || p_partkey END AS id,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '2024-04-15 10:30:00' END AS published, p_type AS summary_html FROM part""")
def feed_items(spark, sf_dir):
    """An RSS feed for each brand of even length, an Atom feed for the others."""
    p = t(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    link = F.concat(F.lit("http://x/"), key)
    odd = F.length("p_brand") % 2 == 1
    guid = lambda name: F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(f"<{name}>g"), key, F.lit(f"</{name}>"))).otherwise("")
    when = F.when(F.col("p_partkey") % 3 == 0, "never")
    rss = F.concat(F.lit("<item>"), guid("guid"), _item("x", ("title", F.col("p_name")), ("link", link), ("pubDate", F.coalesce(when, F.lit("Mon, 15 Apr 2024 10:30:00 GMT"))), ("description", F.col("p_type"))).substr(F.lit(4), F.lit(10_000)), F.lit("</item>"))
    rss = F.replace(rss, F.lit("</x></item>"), F.lit("</item>"))
    atom = F.concat(
        F.lit("<entry>"), guid("id"), F.lit('<link rel="self" href="http://y"/><link href="'), link, F.lit('"/><title>'), F.col("p_name"), F.lit("</title><updated>"),
        F.coalesce(when, F.lit("2024-04-15T10:30:00Z")), F.lit("</updated><summary>"), F.col("p_type"), F.lit("</summary></entry>"),
    )
    title = F.concat(F.lit("<title>T "), F.col("p_brand"), F.lit("</title>"))
    whole = p.select("p_brand", F.when(odd, atom).otherwise(rss).alias("x")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x"))
    body = F.when(odd, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), title, F.col("x"), F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), title, F.col("x"), F.lit("</channel></rss>")))
    got = feeds.read_feeds(whole.select(F.concat(F.lit("u"), "p_brand").alias("url"), F.encode(body, "UTF-8").alias("body")))
    return got.select("feed_url", "feed_title", "title", "url", "id", F.date_format(time.to_utc(F.col("published_at")), "yyyy-MM-dd HH:mm:ss").alias("published"), "summary_html")


@registered("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || p_type WHEN p_partkey % 3 = 1 THEN p_type END AS body, 'wire:' || sha256('g' || p_partkey) AS identity,
 CASE WHEN p_partkey % 3 = 2 THEN 'empty body' END AS error, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'feed' END AS body_source, 'u' AS feed FROM part""")
def feed_documents(spark, sf_dir):
    """Feed items as news: the text of their HTML, the content before the summary, none as a failure."""
    p, rem = t(spark, sf_dir, "part"), F.col("p_partkey") % 3
    items = p.select(
        F.lit("u").alias("feed_url"), F.col("p_name").alias("title"), F.lit("http://x/a?utm_source=b").alias("url"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("id"), F.lit(None).cast("timestamp").alias("published_at"),
        F.when(rem == 1, F.concat(F.lit("<p>"), "p_type", F.lit("</p>"))).alias("summary_html"), F.when(rem == 0, F.concat(F.lit("<div>"), "p_name", F.lit("<br>"), "p_type", F.lit("</div><script>x</script>"))).otherwise("").alias("content_html"),
        F.when(rem == 0, F.create_map(F.lit("body_source"), F.lit("own"))).otherwise(F.create_map(F.lit("x"), F.lit(""))).alias("raw"),
    )
    got = news.prepare(news.feed_documents(items))
    body = F.nullif("body_text", F.lit(""))
    return got.select(F.substring("payload_id", 2, 20).cast("long").alias("p_partkey"), body.alias("body"), "identity", "error", F.col("metadata")["body_source"].alias("body_source"), F.col("metadata")["source_feed_url"].alias("feed"))


@registered("""
SELECT o_custkey AS page_number, o_orderkey AS payload, CASE WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN NULL ELSE 'wire:' || sha256(o_orderkey::VARCHAR) END AS identity,
 CASE WHEN o_orderkey % 5 = 1 THEN 'no link' WHEN o_orderkey % 5 = 2 THEN 'no title' END AS error, '2024-03-02' AS page_date, CASE WHEN o_orderkey % 5 = 3 THEN '' ELSE '10:15 ET' END AS stamp FROM orders""")
def listing_rows(spark, sf_dir):
    """Listing pages with a row for each order of a customer: rows without link or title fail by themselves, and a small text outside the heading is no time."""
    o = t(spark, sf_dir, "orders")
    key, rem = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    link = F.when(rem == 1, "<a>").otherwise(F.concat(F.lit('<a class="newsreleaseconsolidatelink x" href="/news/some-title-'), key, F.lit('.html">')))
    small = F.lit("<small>10:15  ET</small>")
    title = F.when(rem == 2, small).when(rem == 3, F.lit("A &amp; B")).otherwise(F.concat(small, F.lit(" A &amp; B")))
    row = F.concat(F.lit('<div class="row newsCards"><div>'), link, F.lit("<h3>"), title, F.lit("</h3></a><small>read </small><i id="), key, F.lit("></i></div></div>"))
    page = o.groupBy(F.col("o_custkey").alias("page_number")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("x"))
    html = F.concat(F.lit('<input id="date" value="03/02/2024"><div class="row">no</div>'), F.col("x"))
    rows = feeds.read_listings(page.select(F.col("page_number").cast("int").alias("page_number"), html.alias("html"), F.lit("2020-01-01").cast("date").alias("fallback_date")))
    seen = news.observations(rows, "https://www.example.com")
    order = F.regexp_extract("raw_html", r"<i id=(\d+)>", 1).cast("long")
    return seen.select(F.col("page_number").cast("long").alias("page_number"), order.alias("payload"), "identity", "error", F.col("page_date").cast("string").alias("page_date"), F.col("timestamp_text").alias("stamp"))


@registered("""
SELECT event_id AS idx, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE upper(event_type) END AS result, CASE WHEN event_id % 4 = 1 THEN 'ValueError: bad ' || event_type END AS error FROM events""")
def batch_outcomes(spark, sf_dir):
    """A flow over rows: a result, none, or an error, each by itself."""
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "event_type", (F.col("event_id") % 4).alias("rem"))

    def flow(row: dict) -> str | None:
        if row["rem"] == 1:
            raise ValueError(f"bad {row['event_type']}")
        return None if row["rem"] == 0 else row["event_type"].upper()

    return batch.batch_run(e, flow)


@registered("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x' || page_id WHEN 1 THEN '<b>' || page_id || '</b>' WHEN 2 THEN '<a>' || page_id || '</a>' END AS text,
 CASE WHEN page_id % 4 = 3 THEN 'unsupported content type image/png' END AS error FROM pages""")
def content_dispatch(spark, sf_dir):
    """Bodies by content type: HTML as text, plain text and XML as they are, anything else refused."""
    p, i = t(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    rem = F.col("page_id") % 4
    kind = F.element_at(F.array(*map(F.lit, ("Text/HTML; charset=x", "text/plain", "application/xml", "image/png"))), (rem + 1).cast("int"))
    body = F.when(rem == 0, F.concat(F.lit("<p>x"), i, F.lit("</p>"))).when(rem == 1, F.concat(F.lit("<b>"), i, F.lit("</b>"))).when(rem == 2, F.concat(F.lit("<a>"), i, F.lit("</a>"))).otherwise("png")
    return files.text_of(p.select("page_id", kind.alias("content_type"), F.encode(body, "UTF-8").alias("body"))).select("page_id", "text", "error")


@registered("SELECT n_regionkey::VARCHAR AS source_revision_id, sha256(lower(left(n_name, 1))) AS content_hash, 1::BIGINT AS size_bytes, count(*) > 0 AS there FROM nation GROUP BY 1, 2")
def asset_rows(spark, sf_dir):
    """Assets by content: the same letter twice in one region is one asset."""
    n = t(spark, sf_dir, "nation")
    got = files.register_assets(n.select(F.col("n_regionkey").cast("string").alias("source_revision_id"), F.lit("image").alias("kind"), F.lit(1).alias("page_number"), F.encode(F.lower(F.substring("n_name", 1, 1)), "UTF-8").alias("blob")))
    return got.select("source_revision_id", "content_hash", "size_bytes", F.col("asset_id").isNotNull().alias("there"))
