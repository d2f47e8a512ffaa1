"""Registered queries over the driver's tables, each with an oracle in SQL where SQL can say it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text, time
from ..operators import batch, documents, integrity, news, ranking, search, trees, usage
from ..operators import chunking as sentence_chunks
from ..sources.html import html_text
from . import collection, store, values  # noqa: F401 (they register their queries)
from .registry import ORACLES, QUERIES, registered, t  # noqa: F401


# --- search -----------------------------------------------------------------


@registered("""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
FROM embeddings WHERE label IN (1, 2, 3)
ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10""")
def semantic_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    if q is None or q["embedding"] is None:  # nothing to compare with
        return e.limit(0).select("vec_id", F.lit(0.0).alias("score"))
    top = search.rank(e.where(F.col("label").isin(1, 2, 3)), list(q["embedding"]), 10, key="vec_id")
    return top.select("vec_id", F.round("score", 6).alias("score"))


def document_index(spark, sf_dir) -> DataFrame:
    """Documents and labels as an index; what has no label has no known availability. Times spread over the whole table at any size."""
    d, lab = t(spark, sf_dir, "documents").drop("text"), t(spark, sf_dir, "labels")
    as_of = F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") % 1000 * 3600)
    return d.join(lab, "doc_id", "left").select(
        F.concat(F.lit("item:"), F.col("doc_id").cast("string")).alias("target_id"), "doc_id", F.lit("news").alias("item_type"), F.lit("news").alias("artifact_kind"), F.col("source").alias("source_kind"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("confidence"), F.array("lang", "source").alias("tags"),
        F.concat(F.lit("tree-"), F.col("toxic").cast("string")).alias("tree_id"), as_of.alias("as_of"), F.when(F.col("quality").isNotNull(), as_of + F.expr("interval 1 day")).alias("available_at"),
    )


@registered("""
SELECT d.doc_id, d.source AS source_kind FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.source IN ('src0','src1','src2','src3','src4') AND l.quality = 1 AND d.lang = 'en' AND l.toxic = 0
AND d.n_chars % 1000 <= 700 AND l.quality IS NOT NULL AND d.n_chars % 1000 + 24 <= 600""")
def semantic_filter_all(spark, sf_dir):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    at = lambda h: datetime.fromtimestamp(base + h * 3600, timezone.utc)
    q = search.SemanticQuery(
        "any", item_types=("news",), artifact_kinds=("news",), source_kinds=tuple(f"src{i}" for i in range(5)), confidence="high", tags=("en",), tree_id="tree-0", as_of=at(700), available_at=at(600)
    )
    return search.matching(document_index(spark, sf_dir), q).select("doc_id", "source_kind")


@registered("SELECT source, count(*)::BIGINT AS n FROM (SELECT source, list(DISTINCT lang) AS tags FROM documents GROUP BY source) WHERE list_has_all(tags, ['en','de']) GROUP BY source")
def tag_superset(spark, sf_dir):
    tags = t(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("tags"))
    return tags.where(search.has_tags(F.col("tags"), ("en", "de"))).groupBy("source").agg(F.count("*").alias("n"))


@registered("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') WHERE r = 1""")
def point_in_time_latest(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("ts", time.to_utc(F.col("ts")))
    return search.latest_as_of(e, "user_id", "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"), "event_id").select("user_id", "event_id", "event_type", "value")


@registered("""
WITH stored AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE label END AS label, CASE WHEN vec_id % 15 = 0 THEN 'v1' ELSE 'v2' END AS model FROM embeddings WHERE vec_id % 7 <> 0)
SELECT e.vec_id FROM embeddings e LEFT JOIN stored s USING (vec_id) WHERE s.vec_id IS NULL OR e.label IS DISTINCT FROM s.label OR 'v2' IS DISTINCT FROM s.model""")
def reembed_delta(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit("v2").alias("model"))
    stored = e.where("vec_id % 7 <> 0").select("vec_id", F.when(F.col("vec_id") % 10 != 0, F.col("label")).alias("label"), F.when(F.col("vec_id") % 15 == 0, "v1").otherwise("v2").alias("model"))
    return search.stale(e, stored, "vec_id", ["label", "model"]).select("vec_id")


@registered("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0)::BIGINT AS valid, count(DISTINCT len(embedding))::BIGINT AS dimensions FROM embeddings")
def vector_validation(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("n"), F.count_if(search.valid_vector(F.col("embedding"), 64)).alias("valid"), F.countDistinct(F.size("embedding")).alias("dimensions"))


# --- text, addresses, identities ---------------------------------------------


@registered("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@registered("""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(line) AS key, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM x)
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_hash FROM k WHERE key = '' OR prev IS NULL OR key <> prev GROUP BY doc_id""")
def dedupe_lines(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.dedupe_lines(F.col("text")), 256).alias("text_hash"))


@registered(r"""
WITH n AS (SELECT doc_id, replace(replace(text, ' ', ' ' || chr(9) || ' '), chr(10), ' ' || repeat(chr(10), 4)) AS x FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +(\n|$)', '\1', 'g'), ' ' || chr(10) || chr(9))) AS text_hash FROM n""")
def collapse_whitespace(spark, sf_dir):
    noisy = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit(" \t ")), F.lit("\n"), F.lit(" \n\n\n\n"))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse_whitespace(noisy), 256).alias("text_hash"))


CANONICAL = r"""
(SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))
 || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/+$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url
FROM (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
 lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('fbclid','feedref','gclid','mc_cid','mc_eid','spm'))), '&') AS q FROM pages))"""


@registered(f"SELECT page_id, canonical_url FROM {CANONICAL}")
def canonical_url(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))


@registered(f"SELECT 'wire:' || sha256(canonical_url) AS identity, min(page_id) AS first_page, count(*)::BIGINT AS n FROM {CANONICAL} GROUP BY canonical_url")
def url_dedup_identity(spark, sf_dir):
    ids = t(spark, sf_dir, "pages").select("page_id", identity.news_identity(F.lit("press_release"), F.lit(None).cast("string"), F.col("url")).alias("identity"))
    return ids.groupBy("identity").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@registered("""
SELECT p_partkey, unnest([upper(left(p_brand, 2)) || p_size, 'X' || p_size]) AS symbol, unnest(['NASDAQ', 'NYSE American']) AS exchange FROM part""")
def ticker_hints(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    sym = F.concat(F.substring("p_brand", 1, 2), F.col("p_size").cast("string"))
    body = F.concat(F.lit("News ("), F.lit("Nasdaq: "), sym, F.lit(") and NYSE  MKT: [**X"), F.col("p_size").cast("string"), F.lit("**](http://a/b) again NASDAQ:"), sym, F.lit("."))
    hints = p.select("p_partkey", F.explode(text.ticker_hints(body)).alias("h"))
    return hints.select("p_partkey", F.regexp_replace("h.symbol", r"\.$", "").alias("symbol"), "h.exchange").distinct()


@registered("""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('meridia:paper-source:' || sha256(text))) AS s FROM documents)
SELECT doc_id, substr(s,1,8) || '-' || substr(s,9,4) || '-5' || substr(s,14,3) || '-' || substr('89ab', ('0x' || substr(s,17,1))::INT % 4 + 1, 1) || substr(s,18,3) || '-' || substr(s,21,12) AS source_id FROM h""")
def uuid5_ids(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", identity.source_id(text.content_hash(F.col("text"))).alias("source_id"))


# --- time ---------------------------------------------------------------------


@registered("""
WITH d AS (SELECT least(o_orderdate, l_shipdate)::DATE AS lo, greatest(o_orderdate, l_shipdate)::DATE AS hi, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT l_returnflag, hi - lo + 1 AS n, isodow(lo) - 1 AS w FROM d)
SELECT l_returnflag, sum((n // 7) * 5 + n % 7 - greatest(least(w + n % 7, 7) - greatest(w, 5), 0) - greatest(w + n % 7 - 12, 0))::BIGINT AS days, count(*)::BIGINT AS n FROM n GROUP BY 1""")
def business_days(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = time.business_days_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return j.groupBy("l_returnflag").agg(F.sum(days.cast("long")).alias("days"), F.count("*").alias("n"))


@registered("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders")
def parse_dates(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    shown = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "MMMM d, yyyy", "d MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"]
    written = F.date_format(d, shown[0])
    for i, f in enumerate(shown):
        written = F.when(F.col("o_orderkey") % len(shown) == i, F.date_format(d, f)).otherwise(written)
    return o.select("o_orderkey", F.date_format(time.parse_news_datetime(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@registered("""
WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n, (max(ts) OVER (PARTITION BY event_type))::DATE AS d, strftime(ts, '%H:%M') AS h FROM events),
b AS (SELECT *, CASE WHEN h > lag(h) OVER (PARTITION BY event_type ORDER BY n) THEN 1 ELSE 0 END AS back FROM e),
l AS (SELECT event_id, (strftime(d - (sum(back) OVER (PARTITION BY event_type ORDER BY n))::INT, '%Y-%m-%d') || ' ' || h || ':00')::TIMESTAMP AS eastern FROM b)
SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', eastern)), '%Y-%m-%d %H:%M') AS published_at FROM l""")
def listing_rollback(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("ts", time.to_utc(F.col("ts")))
    feed = Window.partitionBy("event_type")
    n = F.row_number().over(feed.orderBy(F.desc("ts"), "event_id"))
    rows = e.select("event_id", "event_type", n.alias("n"), F.to_date(F.max("ts").over(feed)).alias("page_date"), F.concat(F.date_format("ts", "HH:mm"), F.lit(" ET")).alias("timestamp_text"))
    rows = rows.withColumn("page_number", F.floor(F.col("n") / 100)).withColumn("row_number", F.col("n"))
    return news.listing_times(rows, feed="event_type").select("event_id", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


@registered("""
SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12')::BIGINT AS in_window, bool_or(ts < TIMESTAMP '2024-01-10') AS crossed_start, bool_or(ts < TIMESTAMP '2024-01-10') AS complete FROM events""")
def window_filter(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("published_at", time.to_utc(F.col("ts"))).withColumn("time_error", F.lit(False))
    start, end = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (10, 12))
    seen = news.coverage(e, F.lit(start))
    return e.agg(F.count_if(news.in_window(F.col("published_at"), start, end)).alias("in_window")).crossJoin(seen).select("in_window", "crossed_start", "complete")


@registered("SELECT event_type AS failure, CASE WHEN value > 200 THEN 'retry_exhausted' WHEN value > 100 THEN 'timeout' WHEN value > 50 THEN 'network' WHEN value > 20 THEN 'http_status' WHEN value > 5 THEN 'invalid_content' ELSE 'unexpected' END AS error_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def failure_classes(spark, sf_dir):
    v = F.col("value")
    kind = F.when(v > 200, "attempts_exhausted").when(v > 100, "timeout").when(v > 50, "transport").when(v > 20, "http_status").when(v > 5, "value").otherwise("key")
    return t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("failure"), news.error_class(kind).alias("error_type")).agg(F.count("*").alias("n"))


# --- sequences, documents, citations -------------------------------------------

BROKEN_TURNS = "(SELECT conv_id, CASE WHEN conv_id % 10 = 0 AND turn > 0 THEN turn + 1 WHEN conv_id % 7 = 0 AND turn = 1 THEN 0 ELSE turn END AS turn FROM conversations)"


@registered(f"""
SELECT conv_id, count(*)::BIGINT AS n, min(turn) AS lowest, max(turn) AS highest, count(DISTINCT turn)::BIGINT AS kinds FROM {BROKEN_TURNS} GROUP BY conv_id
HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)""")
def contiguity_violations(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    turn = F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") > 0), F.col("turn") + 1).when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), 0).otherwise(F.col("turn"))
    return integrity.contiguous(c.select("conv_id", turn.alias("turn")), "conv_id", "turn")


@registered("SELECT doc_id // 8 AS tile, count(*)::BIGINT AS n, min(doc_id) AS first_id, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def tiling(spark, sf_dir):
    d = documents.tiles(t(spark, sf_dir, "documents"), "doc_id", 8)
    return d.groupBy("tile").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.sum("n_chars").alias("chars"))


@registered(store.BM25)
def bm25_topk(spark, sf_dir):
    return ranking.bm25(t(spark, sf_dir, "documents"), "stupid trash license", 20)


QUOTES = "(SELECT d.doc_id, d.source, b.item_id, strpos(d.text, b.text) - 1 AS start_at FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _quotes(spark, sf_dir) -> DataFrame:
    d, b = t(spark, sf_dir, "documents").select("doc_id", "source", "text"), t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return documents.quotes_in(d, b, "doc_id").select("doc_id", "source", "item_id", F.col("offset").cast("long").alias("start_at"))


@registered(f"SELECT doc_id, item_id, start_at FROM {QUOTES}")
def quote_containment(spark, sf_dir):
    return _quotes(spark, sf_dir).select("doc_id", "item_id", "start_at")


@registered(f"SELECT source AS owner, count(*)::BIGINT AS n, count(DISTINCT item_id)::BIGINT AS pages, count(*) >= 2 AND count(DISTINCT item_id) >= 2 AS covered FROM (SELECT DISTINCT source, doc_id, item_id FROM {QUOTES}) GROUP BY source")
def citation_coverage(spark, sf_dir):
    q = _quotes(spark, sf_dir).select(F.col("source").alias("owner"), F.col("doc_id").alias("chunk_id"), F.col("item_id").alias("page"), F.lit(None).cast("string").alias("quote"), "start_at")
    return documents.covered(documents.distinct_citations(q, "start_at"), 2, 2)


_PAGES = "SELECT doc_id, n + 1 AS page_number, substr(text, n * 2000 + 1, 2000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil(length(text) / 2000.0), 1)::BIGINT)) AS n FROM documents)"


@registered(sentence_chunks.chunk_sql(64, 8, _PAGES))
def chunking(spark, sf_dir):
    pages = documents.pages_of(t(spark, sf_dir, "documents"))
    return sentence_chunks.chunks(pages, 64, 8).select("doc_id", "page_number", "position", "start_char", "end_char", "chunk_id")


@registered("""
WITH x AS (SELECT DISTINCT source, doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS line FROM documents),
s AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, line AS header, count(*)::BIGINT AS k FROM x JOIN s USING (source) WHERE line <> '' GROUP BY source, line, n HAVING count(*) >= 2 AND count(*) >= n * 0.02""".replace("\\\\", "\\"))
def repeated_text(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    lines = d.select("source", F.col("doc_id").alias("page_number"), F.explode(F.split("text", "\n", -1)).alias("text"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("page_height"))
    n = d.groupBy("source").agg(F.count("*").alias("n_pages"))
    return documents.repeated_headers(lines, n, "source", 0.02).select("source", "header", "k")


@registered("""
WITH m AS (SELECT p_brand, median(p_retailprice) AS middle FROM part GROUP BY 1), c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL),
b AS (SELECT p_brand, max(n * 1000 + p_size) AS best FROM c GROUP BY 1) SELECT p_brand, round(middle, 4) AS middle, (best % 1000)::INT AS mode FROM m JOIN b USING (p_brand)""")
def median_and_mode(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    counts = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.max(F.struct("n", "p_size")).alias("best"))
    middle = p.groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 4).alias("middle"))
    return middle.join(counts, "p_brand").select("p_brand", "middle", F.col("best.p_size").alias("mode"))


@registered()
def html_to_text(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@registered("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_payload(spark, sf_dir):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


# --- trees ----------------------------------------------------------------------

GEO = """(SELECT 'geo' AS tree_id, 'root' AS node_id, NULL AS parent_id, 0 AS position UNION ALL SELECT 'geo', 'r' || r_regionkey, 'root', r_regionkey FROM region
UNION ALL SELECT 'geo', 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation)"""
GEO_WALK = f"""WITH RECURSIVE w AS (SELECT *, 0 AS depth, node_id AS path FROM {GEO} WHERE parent_id IS NULL
UNION ALL SELECT g.*, w.depth + 1, w.path || '/' || g.node_id FROM {GEO} g JOIN w ON g.parent_id = w.node_id)"""


def _geo(spark, sf_dir) -> DataFrame:
    r, n = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    row = lambda df, i, p, k: df.select(F.lit("geo").alias("tree_id"), i.alias("node_id"), p.alias("parent_id"), k.cast("int").alias("position"))
    name = lambda c, x: F.concat(F.lit(c), F.col(x).cast("string"))
    root = row(spark.range(1), F.lit("root"), F.lit(None).cast("string"), F.lit(0))
    return root.unionByName(row(r, name("r", "r_regionkey"), F.lit("root"), F.col("r_regionkey"))).unionByName(row(n, name("n", "n_nationkey"), name("r", "n_regionkey"), F.col("n_nationkey")))


@registered(f"{GEO_WALK} SELECT node_id, depth::INT AS depth, path FROM w")
def tree_dfs(spark, sf_dir):
    return trees.walk(spark, _geo(spark, sf_dir)).orderBy("order").select("node_id", "depth", F.array_join("path", "/").alias("path"))


@registered(f"{GEO_WALK} SELECT node_id, path FROM w WHERE depth = 2")
def tree_path(spark, sf_dir):
    w = trees.walk_sql(spark, _geo(spark, sf_dir))
    return w.where("depth = 2").select("node_id", F.array_join("path", "/").alias("path"))


def _conversation_trees(spark, sf_dir) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    tree = F.col("conv_id").cast("string").alias("tree_id")
    root = c.select(tree).distinct().select("tree_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("content"))
    return root.unionByName(c.select(tree, F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node_id"), F.lit("root").alias("parent_id"), F.col("turn").cast("int").alias("position"), F.col("text").alias("content")))


@registered("SELECT conv_id::VARCHAR AS tree_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_hash FROM conversations WHERE text <> '' GROUP BY 1")
def tree_leaf_text(spark, sf_dir):
    nodes = _conversation_trees(spark, sf_dir)
    whole = trees.leaf_text(trees.walk(spark, nodes), nodes)
    return whole.where("node_id = 'root'").select("tree_id", F.sha2("text", 256).alias("text_hash"))


@registered("""
WITH n AS (SELECT conv_id, turn, conv_id % 7 = 0 AND turn = 1 AS lost, CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 0 ELSE turn END AS pos FROM conversations)
SELECT 'known parent' AS rule, count(*)::BIGINT AS n FROM n WHERE lost HAVING count(*) > 0 UNION ALL SELECT 'reachable', count(*) FROM n WHERE lost HAVING count(*) > 0
UNION ALL SELECT 'unique position', count(*) FROM (SELECT conv_id, pos FROM n WHERE NOT lost GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0""")
def tree_violations(spark, sf_dir):
    nodes = _conversation_trees(spark, sf_dir).drop("content")
    conv, first = F.col("tree_id").cast("long"), F.col("node_id") == "t1"
    broken = nodes.withColumn("parent_id", F.when((conv % 7 == 0) & first, "missing").otherwise(F.col("parent_id")))
    broken = broken.withColumn("position", F.when((conv % 11 == 0) & first, 0).otherwise(F.col("position")))
    return trees.violations(broken).groupBy("rule").agg(F.count("*").alias("n"))


@registered()
def serialise_budget(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trees.budgeted(c, 150, "conv_id", "turn", "role", "text").select("conv_id", F.length("serialised").alias("n_chars"), "truncated", F.sha2("serialised", 256).alias("text_hash"))


# --- integrity and the store ------------------------------------------------------


@registered("""
SELECT 'labels' AS child, count(*)::BIGINT AS n FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.doc_id % 10 <> 0)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 20 <> 1)""")
def orphan_records(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id").where("doc_id % 10 <> 0")
    o = t(spark, sf_dir, "orders").where("o_orderkey % 20 <> 1").select(F.col("o_orderkey").alias("l_orderkey"))
    a = integrity.orphans(t(spark, sf_dir, "labels"), d, ["doc_id"]).agg(F.lit("labels").alias("child"), F.count("*").alias("n"))
    return a.unionByName(integrity.orphans(t(spark, sf_dir, "lineitem"), o, ["l_orderkey"]).agg(F.lit("lineitem").alias("child"), F.count("*").alias("n")))


@registered("""
SELECT source, count(*)::BIGINT AS documents, count(l.doc_id)::BIGINT AS labelled, count(DISTINCT lang)::BIGINT AS langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source HAVING count(*) <> count(l.doc_id)""")
def completeness(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.countDistinct("lang").alias("langs")).where("documents <> labelled")


@registered("""
SELECT c_mktsegment, o_orderstatus, count(*)::BIGINT AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def three_way_load(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    o, c = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # lines are summed per order before they meet the customers, so the second exchange is a row per order
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("p"))
    j = per.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderstatus").agg(F.sum("n").alias("n"), F.sum("p").cast("double").alias("price"))


@registered("""
WITH delta AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', 5.0 FROM orders WHERE o_orderkey % 1000 = 1)
SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM delta WHERE delta.o_orderkey = orders.o_orderkey) UNION ALL SELECT * FROM delta)""")
def upsert_snapshot(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 1000 = 1").select(F.col("o_orderkey") + 100000000, F.lit("N"), F.lit(5.0)).toDF(*o.columns)
    delta = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(new)
    return o.join(delta.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(delta)


@registered("""
SELECT 'customer' AS tbl, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 50 <> 0
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 50 = 0)""")
def cascade_delete(spark, sf_dir):
    c, o, li = (t(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    gone = c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("o_custkey"))
    lost = o.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = (("customer", c.where("c_custkey % 50 <> 0")), ("orders", o.join(gone, "o_custkey", "left_anti")), ("lineitem", li.join(lost, "l_orderkey", "left_anti")))
    rows = [df.agg(F.lit(n).alias("tbl"), F.count("*").alias("n")) for n, df in kept]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@registered("""
SELECT 'left' AS side, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)
UNION ALL SELECT 'right', doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def set_difference(spark, sf_dir):
    a, b = t(spark, sf_dir, "labels").select("doc_id"), t(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id")
    return integrity.same_set(a, b).select("side", "doc_id")


# --- batches and usage -------------------------------------------------------------


@registered("SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE event_type NOT IN ('error','view'))::BIGINT AS success, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failure FROM events")
def batch_rollup(spark, sf_dir):
    kind = F.col("event_type")
    done = t(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.when(~kind.isin("error", "view"), kind).alias("result"), F.when(kind == "error", "ValueError").alias("error"))
    return batch.counts(done)


@registered("""
WITH s AS (SELECT (user_id % 50)::VARCHAR AS trace_id, ts, event_id % 60 AS d, event_id % 100 AS i, event_id % 7 AS o, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 END AS tot FROM events WHERE event_type IN ('click','view'))
SELECT trace_id, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(coalesce(nullif(tot, 0), i + o))::BIGINT AS total_tokens, count(*)::BIGINT AS requests,
round((epoch_us(max(ts + to_seconds(d))) - epoch_us(min(ts))) / 1e6, 6) AS wall_seconds, round(sum(d)::DOUBLE, 6) AS busy_seconds FROM s GROUP BY 1""")
def usage_rollup(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("ts", time.to_utc(F.col("ts")))
    kind = F.when(F.col("event_type") == "click", "generation").when(F.col("event_type") == "view", "response").otherwise("task")
    n = F.col("event_id")
    counts = F.map_filter(F.create_map(F.lit("input_tokens"), n % 100, F.lit("output_tokens"), n % 7, F.lit("total_tokens"), F.when(n % 3 != 0, n % 11)), lambda k, v: v.isNotNull())
    show = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    spans = e.select(
        n.cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), (F.col("user_id") % 50).cast("string").alias("trace_id"), kind.alias("type"), F.lit("m").alias("name"), F.lit("m").alias("model"),
        F.date_format("ts", show).alias("started_at"), F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n % 60).cast("decimal(18,6)")), show).alias("ended_at"), counts.alias("usage"),
        F.lit(None).cast("struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>").alias("response"),
    )
    return usage.roll_up(usage.steps(spans))


@registered("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL".replace("time_bucket(INTERVAL 1 DAY, ts) AS day", "strftime(ts, '%Y-%m-%d') AS day"))
def daily_windows(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("ts", time.to_utc(F.col("ts")))
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
