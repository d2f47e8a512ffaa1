"""Registered queries over text, identifier and time functions, outlines and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, time
from ..operators import documents, providers, trees, usage
from ..operators.ancestry import shuffled
from ..plans.schemas import SPAN
from .registry import registered, t


def _case(key: str, options: list, kind: str = "string"):
    """One of the options by the key's remainder, in Spark."""
    out = F.lit(options[-1]).cast(kind)
    for i, o in enumerate(options[:-1]):
        out = F.when(F.col(key) % len(options) == i, F.lit(o).cast(kind)).otherwise(out)
    return out


def _sql_case(key: str, options: list) -> str:
    """The same in SQL; None is null."""
    show = lambda o: "NULL" if o is None else str(o) if isinstance(o, int) else "'" + o.replace("'", "''") + "'"
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {show(o)}" for i, o in enumerate(options)) + " END"


IDS = [
    ("https://doi.org/10.1000/xyz", "10.1000/xyz", None), ("DOI:10.1000/xyz", "10.1000/xyz", None), ("doi:10.5555/a(b)", "10.5555/a(b)", None), (" http://doi.org/10.1/x", None, None),
    ("https://dx.doi.org/10.1000/xyz", None, None), ("arXiv:2401.12345v2", None, "2401.12345v2"), ("https://arxiv.org/abs/hep-th/9901001", None, "hep-th/9901001"),
    ("https://arxiv.org/pdf/1706.03762", None, "1706.03762"), ("plain words", None, None),
]


@registered(f"SELECT p_partkey, {_sql_case('p_partkey', [i[1] for i in IDS])} AS doi, {_sql_case('p_partkey', [i[2] for i in IDS])} AS arxiv_id FROM part")
def paper_ids(spark, sf_dir):
    raw = t(spark, sf_dir, "part").select("p_partkey", _case("p_partkey", [i[0] for i in IDS]).alias("raw"))
    return raw.select("p_partkey", text.doi(F.col("raw")).alias("doi"), text.arxiv_id(F.col("raw")).alias("arxiv_id"))


NUMBERS = [("12", 12), ("iv", 4), ("xix", 19), ("MCMXC", 1990), ("0", None), ("x1", None), ("", None), ("cdxliv", 444)]


@registered(f"SELECT p_partkey, {_sql_case('p_partkey', [n for _, n in NUMBERS])} AS page FROM part")
def printed_pages(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.printed_page(_case("p_partkey", [n for n, _ in NUMBERS])).alias("page"))


@registered("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/markdown' ELSE 'application/octet-stream' END AS kind,
 CASE WHEN p_partkey % 2 = 0 THEN 'a,' || p_brand || ',b' ELSE 'a,b' END AS tags, CASE WHEN p_partkey % 3 = 0 THEN '{"k": 1}' ELSE 'plain' END AS body FROM part""")
def small_values(spark, sf_dir):
    """Content types by suffix, tags appended once, JSON out of its fence."""
    p = t(spark, sf_dir, "part")
    path = F.concat(F.lit("/x/"), "p_name", _case("p_partkey", [".PDF", ".htm", ".md", ".bin"]))
    old = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.col("p_brand"))).otherwise(F.array(F.lit("a")))
    tags = text.append_tags(old, F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    body = F.when(F.col("p_partkey") % 3 == 0, '```json\n{"k": 1}\n```').otherwise("plain")
    return p.select("p_partkey", text.content_type(path).alias("kind"), F.array_join(tags, ",").alias("tags"), text.json_fence_stripped(body).alias("body"))


@registered("""
SELECT doc_id, sha256('fi "x" - it''s 1' || chr(10) || chr(10) || trim(text) || chr(10) || chr(10) || ' [email protected]') AS text_hash FROM documents
WHERE lang = 'en' AND length(text) = strlen(text) AND trim(text) <> '' AND NOT contains(text, '  ') AND NOT contains(text, chr(10))""")
def news_text(spark, sf_dir):
    """Compatibility forms, quotes, dashes, repeated lines, blank gaps and protected addresses around one line of text."""
    d = t(spark, sf_dir, "documents").where("lang = 'en' and length(text) = octet_length(text) and trim(text) <> '' and not contains(text, '  ') and not contains(text, '\n')")
    line = "\ufb01 \u201cx\u201d \u2013 it\u2019s \u2460"
    noisy = F.concat(F.lit(f"{line}\n {line}\n\n\n\n"), F.col("text"), F.lit("  \n\x00\n [[email\xa0protected]](/cdn-cgi/l/email-protection#ab12)\t"))
    return text.with_news_text(d.withColumn("noisy", noisy), "noisy").select("doc_id", F.sha2("noisy", 256).alias("text_hash"))


@registered("""
SELECT o_orderkey, strftime(make_date(year(o_orderdate)::INT, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE month(o_orderdate)::INT END, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE day(o_orderdate)::INT END), '%Y-%m-%d') AS part,
 strftime(date_trunc('hour', ts + INTERVAL '3599999999 microseconds'), '%Y-%m-%d %H:%M:%S') AS hour, (epoch_us(ts) - epoch_us(o_orderdate)) / 1e6 AS age
FROM orders JOIN events ON event_id = o_orderkey""")
def time_values(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "events"), F.col("event_id") == F.col("o_orderkey"))
    day, at, key = time.to_utc(F.col("o_orderdate")), time.to_utc(F.col("ts")), F.col("o_orderkey") % 3
    part = time.partial_date(F.year(day), F.when(key != 0, F.month(day)), F.when(key == 2, F.dayofmonth(day)))
    return o.select("o_orderkey", part.cast("string").alias("part"), F.date_format(time.ceil_to_hour(at), "yyyy-MM-dd HH:mm:ss").alias("hour"), time.freshness_seconds(day, at).alias("age"))


# --- outlines ------------------------------------------------------------------------


@registered("""
WITH b AS (SELECT source, doc_id AS page_number, CASE doc_id % 4 WHEN 0 THEN doc_id - 3 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE doc_id - 5 END AS printed FROM documents),
o AS (SELECT source, page_number - printed AS o, count(*) AS n FROM b WHERE printed BETWEEN 1 AND 9999 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, o DESC) AS r FROM o) SELECT source, o AS printed_page_offset FROM r WHERE r = 1 AND n >= 2""")
def page_offsets(spark, sf_dir):
    """Feet that are numbers alone count; "Page 3" and "- 3 -" do not."""
    i = F.col("doc_id")
    foot = F.when(i % 4 == 0, (i - 3).cast("string")).when(i % 4 == 1, F.concat(F.lit("Page "), (i - 7).cast("string"))).when(i % 4 == 2, F.concat(F.lit("- "), (i - 9).cast("string"), F.lit(" -"))).otherwise(F.concat(F.lit("  "), (i - 5).cast("string"), F.lit(" ")))
    b = t(spark, sf_dir, "documents").select("source", i.alias("page_number"), F.lit(0).alias("position"), foot.alias("text"), F.lit(90.0).alias("y0"), F.lit(100.0).alias("page_height"))
    return documents.page_offset(b, "source")


PAGES = ["Contents\nOne ...... 3\nTwo .. 14", "Contents\nA . 1\nOne ...... 3", "Table of  Contents\nOne ... iv\nTwo ... ix", "TABLE OF CONTENTS\nFirst part.....1\nx\nSecond part ....... 22 ", "One ...... 3\nTwo .. 14"]


@registered("SELECT doc_id, 1 AS page_number FROM documents WHERE doc_id % 5 IN (0, 3)")
def contents_lines(spark, sf_dir):
    return documents.contents_pages(t(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), _case("doc_id", PAGES).alias("text")))


HEADS = [("1.2 Scope of work", 9.0, 2), ("LARGE LETTERS ALONE", 9.0, 2), ("some ordinary words of the body", 9.0, None), ("a title in print", 13.5, 1), ("a lesser title", 11.0, 2), ("3) Third", 9.0, 1), ("running head", 30.0, None)]


@registered(f"SELECT o_custkey AS doc_id, o_orderkey::INT AS page_number, {_sql_case('o_orderkey', [h[2] for h in HEADS])} AS level_hint FROM orders WHERE o_orderkey % 7 NOT IN (2, 6)")
def heading_levels(spark, sf_dir):
    """Numbers, size and capitals make headings; a repeated header does not. The body's size is the median of its longer blocks."""
    o = t(spark, sf_dir, "orders")
    size = F.when(F.col("o_orderkey") % 7 == 3, 13.5).when(F.col("o_orderkey") % 7 == 4, 11.0).when(F.col("o_orderkey") % 7 == 6, 30.0).otherwise(9.0)
    blocks = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page_number"), _case("o_orderkey", [h[0] for h in HEADS]).alias("text"), size.alias("font_size"))
    body = blocks.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(9.0), F.lit(9.0), F.lit(8.0))).alias("font_size"), F.lit("a block of twenty letters or more").alias("text"))
    sizes = documents.body_font(body)
    heads = blocks.select("doc_id").distinct().withColumn("header", F.lit("running head"))
    return documents.headings(blocks, sizes, heads).select("doc_id", "page_number", "level_hint")


@registered("SELECT p_brand AS doc_id, median(p_retailprice) AS body_size FROM part WHERE p_size >= 20 GROUP BY 1")
def body_fonts(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return documents.body_font(p.select(F.col("p_brand").alias("doc_id"), F.repeat(F.lit("x"), F.col("p_size")).alias("text"), F.col("p_retailprice").alias("font_size")))


@registered("SELECT conv_id, turn AS page_number, list_sort(['a' || turn || 'x', 'a' || turn || 'y']) AS ids, length(text) + 0 AS n FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, [], length(text) FROM conversations WHERE turn % 2 = 1")
def assets_of_pages(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_number"), F.length("text").cast("long").alias("n"))
    assets = c.where("page_number % 2 = 0").select("conv_id", "page_number", F.explode(F.transform(F.array(F.lit("y"), F.lit("x"), F.lit("x")), lambda x: F.concat(F.lit("a"), F.col("page_number").cast("string"), x))).alias("asset_id"))
    return documents.page_assets(c, assets, "conv_id").withColumnRenamed("asset_ids", "ids")


@registered("""
SELECT conv_id AS doc_id, turn AS chunk_index, CASE WHEN turn % 4 = 1 THEN 'chunk outside its group' WHEN turn % 4 = 2 THEN 'page outside its chunk' ELSE 'quote not in its chunk' END AS rule
FROM conversations WHERE turn % 4 <> 0 AND length(text) > 0""")
def findings(spark, sf_dir):
    """Each finding names a chunk; remainders 1 to 3 break one rule each."""
    c = t(spark, sf_dir, "conversations").where("length(text) > 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.array(F.col("turn") + 1).alias("pages"), "text")
    kind = F.col("chunk_index") % 4
    groups = c.select("doc_id", F.col("chunk_index").alias("group"), F.when(kind == 1, F.col("chunk_index") + 1).otherwise(F.col("chunk_index")).alias("start"), F.lit(1).alias("count"))
    made = c.select("doc_id", F.col("chunk_index").alias("group"), "chunk_index", F.when(kind == 2, F.lit(99)).otherwise(F.col("chunk_index") + 1).alias("page"), F.when(kind == 3, F.concat("text", F.lit("!"))).otherwise(F.substring("text", 1, 5)).alias("quote"))
    return documents.finding_violations(groups, made, c).select("doc_id", "chunk_index", "rule")


# --- trees ------------------------------------------------------------------------------


def _turn_nodes(spark, sf_dir) -> DataFrame:
    """A root for each conversation that names all its turns as pages, and a leaf for each turn."""
    c = t(spark, sf_dir, "conversations")
    tree = F.col("conv_id").cast("string").alias("tree_id")
    leaf = c.select(tree, F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node_id"), F.lit("root").alias("parent_id"), F.col("turn").cast("int").alias("position"), F.array(F.col("turn").cast("int") + 1).alias("pages"), F.col("role").alias("title"), F.col("text").alias("content"))
    root = c.groupBy(tree).agg(F.array_sort(F.collect_set(F.col("turn").cast("int") + 1)).alias("pages"))
    return leaf.unionByName(root.select("tree_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("position"), "pages", F.lit("all").alias("title"), F.lit(None).cast("string").alias("content")))


@registered("SELECT conv_id::VARCHAR AS tree_id, 'root covers source' AS rule, max(turn)::INT + 2 AS page FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1 UNION ALL SELECT conv_id::VARCHAR, 'page in source', max(turn)::INT + 1 FROM conversations WHERE conv_id % 5 = 1 GROUP BY 1")
def tree_sources(spark, sf_dir):
    nodes = _turn_nodes(spark, sf_dir)
    conv = F.col("tree_id").cast("long")
    pages = nodes.where("parent_id is null").select("tree_id", F.explode("pages").alias("page"))
    last = pages.groupBy("tree_id").agg(F.max("page").alias("page"))
    pages = pages.join(last.where(conv % 5 == 1), ["tree_id", "page"], "left_anti").unionByName(last.where(conv % 3 == 0).withColumn("page", F.col("page") + 1))
    return trees.source_violations(nodes, pages)


@registered("SELECT conv_id::VARCHAR AS tree_id, conv_id % 4 = 0 AS intact, CASE WHEN conv_id % 4 = 2 THEN count(*) ELSE count(*) + 1 END::BIGINT AS n FROM conversations GROUP BY conv_id")
def tree_rows(spark, sf_dir):
    """Trees split into rows and put together again; of those with a remainder of 1 to 3 a row is changed, lost or rewritten with its hash."""
    nodes = _turn_nodes(spark, sf_dir)
    whole = nodes.groupBy("tree_id").agg(F.collect_list(F.struct("node_id", "parent_id", "position", "title", "content")).alias("nodes"))
    kept, rows = trees.split_trees(whole)
    rem, first = F.col("tree_id").cast("long") % 4, F.col("node_id") == "t0"
    rows = rows.where(~((rem == 2) & first)).withColumn("payload_json", F.when((rem % 2 == 1) & first, F.replace(F.col("payload_json"), F.lit('"position":0'), F.lit('"position":7'))).otherwise(F.col("payload_json")))
    rows = rows.withColumn("content_hash", F.when((rem == 3) & first, F.sha2("payload_json", 256)).otherwise(F.col("content_hash")))
    back = trees.assembled(kept, rows, "struct<node_id:string,parent_id:string,position:int,title:string,content:string>")
    return back.select("tree_id", "intact", F.size("nodes").cast("long").alias("n"))


@registered("""
SELECT conv_id::VARCHAR AS tree_id, 't' || turn AS node_id, role AS title, sha256(text) AS content_hash, turn::INT + 1 AS page FROM conversations WHERE text <> ''""")
def tree_evidence(spark, sf_dir):
    nodes = _turn_nodes(spark, sf_dir)
    leaves = nodes.where("parent_id is not null and content <> ''")
    texts = trees.leaf_text(trees.walk(spark, nodes), nodes)
    return trees.evidence(leaves, texts).select("tree_id", "node_id", "title", F.sha2("content", 256).alias("content_hash"), F.col("pages")[0].alias("page"))


@registered("""
SELECT 'geo' AS tree_id, ['root', 'r' || n_regionkey, 'n' || n_nationkey] AS path FROM nation UNION ALL SELECT 'geo', ['root', 'r' || r_regionkey] FROM region UNION ALL SELECT 'geo', ['root']""")
def node_path(spark, sf_dir):
    """The path to every node."""
    from .queries import _geo

    return trees.find_path(trees.walk(spark, _geo(spark, sf_dir)), F.col("node_id"))


@registered("""
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, count(*) OVER (PARTITION BY conv_id) AS n, role, text FROM conversations),
h AS (SELECT conv_id, page, n, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS i, coalesce(lead(page) OVER (PARTITION BY conv_id ORDER BY page) - 1, n) AS stop FROM p WHERE role = 'user'),
k AS (SELECT * FROM h UNION ALL SELECT conv_id, 1, max(n), 0, max(n) FROM p GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') = 0)
SELECT k.conv_id::VARCHAR AS doc_id, '0.' || i AS node_id, '0' AS parent_id, i::INT AS position, sha256(string_agg(text, chr(10) || chr(10) ORDER BY p.page)) AS content_hash, (stop - k.page + 1)::INT AS n_pages
FROM k JOIN p ON p.conv_id = k.conv_id AND p.page BETWEEN k.page AND stop GROUP BY k.conv_id, i, k.page, stop
UNION ALL SELECT conv_id::VARCHAR, '0', NULL, 0, NULL, max(n)::INT FROM p GROUP BY conv_id""")
def draft_trees(spark, sf_dir):
    """Trees from outlines: a page for each turn, a heading at each user turn."""
    c = t(spark, sf_dir, "conversations")
    docs = c.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    texts = F.map_from_arrays(F.sequence(F.lit(1), F.size("p")), F.transform("p", lambda x: x["text"]))
    heads = F.filter(F.transform("p", lambda x, i: F.struct((i + 1).alias("page"), x["role"].alias("title"), F.lit(1).alias("level"))), lambda h: h["title"] == "user")
    built = providers.build_trees(docs.select("doc_id", F.lit("T").alias("title"), texts.alias("page_texts"), heads.alias("headings")))
    return built.select("doc_id", "node_id", "parent_id", "position", F.sha2("content", 256).alias("content_hash"), F.size("pages").alias("n_pages"))


# --- usage -----------------------------------------------------------------------------------


@registered("""
WITH RECURSIVE s AS (SELECT event_id AS id, CASE WHEN event_id % 8 <> 0 THEN event_id // 8 * 8 + event_id % 8 // 2 END AS up, CASE WHEN event_id % 8 IN (0, 3) THEN 'agent' WHEN event_id % 8 >= 4 THEN 'generation' ELSE 'task' END AS kind FROM events),
w AS (SELECT id AS span, up AS at FROM s WHERE kind = 'generation' UNION ALL SELECT w.span, s.up FROM w JOIN s ON s.id = w.at WHERE s.kind <> 'agent')
SELECT w.span::VARCHAR AS span_id, 'a' || s.id AS label FROM w JOIN s ON s.id = w.at AND s.kind = 'agent'""")
def span_labels(spark, sf_dir):
    """Eight spans a trace, each below the one of half its number; 0 and 3 are agents, 4 to 7 are generations."""
    e, i = t(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    up = F.when(i % 8 != 0, F.floor(i / 8) * 8 + F.floor(i % 8 / 2)).cast("long")
    kind = F.when((i % 8).isin(0, 3), "agent").when(i % 8 >= 4, "generation").otherwise("task")
    own = {"span_id": i.cast("string"), "parent_id": up.cast("string"), "trace_id": F.floor(i / 8).cast("string"), "type": kind, "name": F.concat(F.lit("a"), i.cast("string"))}
    spans = e.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SPAN])
    return usage.labels(spans).select("span_id", "label")


@registered("SELECT event_id::VARCHAR AS span_id, row_number() OVER (ORDER BY CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END NULLS FIRST, event_id::VARCHAR) AS nth FROM events ORDER BY nth LIMIT 50")
def first_steps(spark, sf_dir):
    """The first 50 steps in their order."""
    e = t(spark, sf_dir, "events").withColumn("ts", time.to_utc(F.col("ts")))
    steps = e.select(F.col("event_id").cast("string").alias("span_id"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("started_at"))
    first = usage.in_order(steps).limit(50)
    rows = first.collect()  # 50 rows
    return spark.createDataFrame([(r["span_id"], n) for n, r in enumerate(rows, 1)], "span_id string, nth long")


#: trees of conversations: a turn is a child of the turn before it if its number is odd, else of the root; each remainder of 20 breaks something
_RULES = """
WITH RECURSIVE c AS (SELECT conv_id AS g, turn::INT AS t, conv_id % 20 AS d FROM conversations),
l AS (SELECT g, d, 't' || t AS id, CASE WHEN t % 2 = 1 THEN 't' || (t - 1) ELSE 'root' END AS up, t AS pos, t FROM c),
b AS (SELECT g, d, id, up, pos, t, [t + 1] || CASE WHEN t % 2 = 0 THEN [t + 2] ELSE [] END AS pages FROM l),
r AS (SELECT g, any_value(d) AS d, 'root' AS id, NULL AS up, -1 AS pos, NULL::INT AS t, list(DISTINCT p ORDER BY p) AS pages FROM (SELECT g, d, unnest(pages) AS p FROM b) GROUP BY g),
m AS (SELECT g, d, id, CASE WHEN d = 1 AND t = 1 THEN 'gone' WHEN d = 2 AND t = 0 THEN NULL WHEN d = 3 AND t = 0 THEN 't1' ELSE up END AS up, CASE WHEN d = 4 AND t = 2 THEN 0 ELSE pos END AS pos,
 CASE WHEN d = 5 AND t = 1 THEN [0] WHEN d = 6 AND t = 1 THEN [99] ELSE pages END AS pages FROM (SELECT g, d, id, up, pos, t, pages FROM b UNION ALL SELECT * FROM r) WHERE d <> 7),
n AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE d = 8 AND id = 't1'),
k AS (SELECT g, up AS id, list(id) AS kids FROM (SELECT DISTINCT g, CASE WHEN t % 2 = 1 THEN 't' || (t - 1) ELSE 'root' END AS up, id FROM l) GROUP BY ALL),
links AS (SELECT n.g, n.d, n.id AS up, unnest(CASE WHEN d = 9 AND n.id = 'root' THEN ['t0'] ELSE [] END || CASE WHEN d = 10 AND n.id = 'root' THEN ['odd'] ELSE [] END || list_filter(coalesce(kids, []), lambda x: NOT (n.d = 11 AND x = 't1'))) AS id FROM n LEFT JOIN k ON k.g = n.g AND k.id = n.id),
w AS (SELECT g, id FROM n WHERE up IS NULL UNION SELECT n.g, n.id FROM n JOIN w ON w.g = n.g AND n.up = w.id),
p AS (SELECT DISTINCT g, t + 1 AS p FROM l UNION SELECT g, t + 2 FROM l),
v AS (SELECT 'one root' AS rule FROM n GROUP BY g HAVING count(*) FILTER (WHERE up IS NULL) <> 1
 UNION ALL SELECT 'unique id' FROM n GROUP BY g, id HAVING count(*) > 1
 UNION ALL SELECT 'unique position' FROM n GROUP BY g, up, pos HAVING count(*) > 1
 UNION ALL SELECT 'known parent' FROM n WHERE up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n o WHERE o.g = n.g AND o.id = n.up)
 UNION ALL SELECT 'reachable' FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.g = n.g AND w.id = n.id)
 UNION ALL SELECT 'no nodes' FROM (SELECT DISTINCT g, d FROM c) x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.g = x.g)
 UNION ALL SELECT 'declared root' FROM (SELECT DISTINCT g, d FROM c) x WHERE d = 12
 UNION ALL SELECT 'unique child link' FROM links GROUP BY g, up, id HAVING count(*) > 1
 UNION ALL SELECT 'child names parent' FROM links WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.g = links.g AND n.up = links.up AND n.id = links.id)
 UNION ALL SELECT 'parent names child' FROM n WHERE up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links WHERE n.g = links.g AND n.up = links.up AND n.id = links.id)
 UNION ALL SELECT 'positive page' FROM n WHERE len(list_filter(pages, lambda x: x < 1)) > 0
 UNION ALL SELECT 'page within parent' FROM n JOIN n o ON o.g = n.g AND o.id = n.up WHERE len(list_filter(n.pages, lambda x: NOT list_contains(o.pages, x))) > 0
 UNION ALL SELECT 'page in source' FROM (SELECT g, unnest(pages) AS p FROM n) x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = x.g AND p.p = x.p))
SELECT rule, count(*)::BIGINT AS n FROM v GROUP BY rule"""


@registered(_RULES)
def tree_rules(spark, sf_dir):
    """All thirteen rules of a tree with links and pages, each broken in some conversations."""
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree_id"), F.col("turn").cast("int").alias("t"), (F.col("conv_id") % 20).alias("d"))
    d, turn, name = F.col("d"), F.col("t"), lambda k: F.concat(F.lit("t"), k.cast("string"))
    own = F.when(turn % 2 == 1, name(turn - 1)).otherwise("root")
    pages = F.when(turn % 2 == 0, F.array(turn + 1, turn + 2)).otherwise(F.array(turn + 1))
    leaf = c.select("tree_id", "d", name(turn).alias("node_id"), own.alias("parent_id"), turn.alias("position"), "t", pages.alias("pages"))
    kids = leaf.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.collect_set("node_id").alias("kids"))
    root = leaf.groupBy("tree_id", "d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    root = root.select("tree_id", "d", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(-1).alias("position"), F.lit(None).cast("int").alias("t"), "pages")
    n = leaf.unionByName(root).where("d <> 7").join(shuffled(kids), ["tree_id", "node_id"], "left")
    at = lambda k, i: (d == k) & F.coalesce(turn == i, F.lit(False))
    top = F.col("node_id") == "root"
    none = F.array().cast("array<string>")
    shown = F.filter(F.coalesce("kids", none), lambda x: ~((F.col("d") == 11) & (x == "t1")))
    n = n.select(
        "tree_id", "node_id", F.when(at(1, 1), "gone").when(~at(2, 0), F.when(at(3, 0), "t1").otherwise(F.col("parent_id"))).alias("parent_id"), F.when(at(4, 2), 0).otherwise(F.col("position")).alias("position"), "d",
        F.concat(F.when((d == 9) & top, F.array(F.lit("t0"))).otherwise(none), F.when((d == 10) & top, F.array(F.lit("odd"))).otherwise(none), shown).alias("children_ids"),
        F.when(at(5, 1), F.array(F.lit(0))).when(at(6, 1), F.array(F.lit(99))).otherwise(F.col("pages")).alias("pages"),
    )
    n = n.unionByName(n.where("d = 8 and node_id = 't1'"))
    held = c.select("tree_id", F.explode(F.array(turn + 1, turn + 2)).alias("page")).distinct()
    declared = c.groupBy("tree_id", "d").agg(F.lit(1)).select("tree_id", F.when(d == 12, "other").otherwise("root").alias("root_id"))
    return trees.violations(n, held, declared).groupBy("rule").agg(F.count("*").alias("n"))
