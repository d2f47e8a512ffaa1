"""Registered queries over the store: projections, integrity, upserts, deletes and hits, through the library itself."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time
from ..operators import integrity, projection, text_index
from ..operators.ancestry import shared_folder
from ..operators.library import KnowledgeLibrary
from ..operators.search import SemanticQuery
from .registry import registered, t


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def length_vector(text: str) -> list[float]:
    """A provider that SQL can follow."""
    return [float(len(text)), 100.0]


def _news(spark, sf_dir) -> DataFrame:
    """A flat item of each kind in turn from documents, without their texts."""
    d = t(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("news", "earnings", "factor", "thesis"))), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.to_json(
        F.struct(
            F.col("source").alias("headline"), F.col("lang").alias("event_type"), F.array("lang", "source").alias("entities"),
            F.col("source").alias("ticker"), F.lit("2026Q1").alias("period"), F.when(F.col("doc_id") % 8 == 1, F.col("lang")).alias("guidance"),
            F.col("source").alias("factor_name"), F.when(F.col("doc_id") % 8 == 2, F.col("lang")).alias("universe"), F.concat("source", F.lit(" rises by "), F.col("n_chars").cast("string")).alias("claim"),
            F.array(F.struct(F.lit("s").alias("source_id"), (F.col("doc_id") % 9).cast("int").alias("page"), F.col("lang").alias("quote"))).alias("citations"),
        )
    )
    return d.select(
        F.col("doc_id").cast("string").alias("item_id"), F.lit("flat").alias("knowledge_class"), kind.alias("item_type"), F.lit("flat").alias("item_shape"), F.lit("1.0").alias("schema_version"), body.alias("payload_json"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars")).alias("as_of"), F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") + 60).alias("available_at"), F.col("source").alias("source_kind"), F.lit("medium").alias("confidence"), F.array("lang").alias("tags"),
    )


TEXT = """CASE doc_id % 4 WHEN 0 THEN source || chr(10) || lang || chr(10) || lang || ', ' || source WHEN 1 THEN rtrim(source || ' 2026Q1 earnings' || chr(10) || CASE WHEN doc_id % 8 = 1 THEN lang ELSE '' END, chr(10))
 WHEN 2 THEN 'factor ' || source || ' on ' || CASE WHEN doc_id % 8 = 2 THEN lang ELSE 'unspecified' END ELSE source || ' rises by ' || n_chars END"""


def _trees(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tree items from conversations: a root and a node for each turn."""
    c = t(spark, sf_dir, "conversations")
    item = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("item_id")
    body = lambda title, summary: F.to_json(F.struct(title.alias("title"), summary.alias("summary"), F.array(F.struct(F.lit("c").alias("source_id"), F.lit(1).alias("page"))).alias("citations")))
    leaf = c.select(item, F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node_id"), F.lit("root").alias("parent_id"), F.col("turn").cast("int").alias("position"), body(F.col("role"), F.substring("text", 1, 40)).alias("payload_json"))
    one = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    root = one.select(item, F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("position"), body(F.lit("talk"), F.col("n").cast("string")).alias("payload_json"))
    items = one.select(
        item, F.lit("tree").alias("knowledge_class"), F.lit("talk").alias("item_type"), F.lit("tree").alias("item_shape"), F.lit("1.0").alias("schema_version"), F.to_json(F.struct("conv_id")).alias("payload_json"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("as_of"), F.lit("talk").alias("source_kind"),
    )
    return items, leaf.unionByName(root)


@registered(f"""
SELECT 'item:' || doc_id AS target_id, NULL AS tree_id, sha256({TEXT}) AS projection_hash FROM documents
UNION ALL SELECT 'item:c' || conv_id, 'c' || conv_id, sha256('talk' || chr(10) || count(*)) FROM conversations GROUP BY conv_id
UNION ALL SELECT 'node:c' || conv_id || ':t' || turn, 'c' || conv_id, sha256(role || chr(10) || substr(text, 1, 40)) FROM conversations""")
def search_targets(spark, sf_dir):
    flat, (items, nodes) = _news(spark, sf_dir), _trees(spark, sf_dir)
    return projection.search_targets(flat.unionByName(items, allowMissingColumns=True), nodes).select("target_id", "tree_id", "projection_hash")


def _paper(spark, sf_dir) -> dict[str, DataFrame]:
    """A source for each source column value, with a chunk set of its documents and a summary."""
    d = t(spark, sf_dir, "documents").where("text rlike '\\\\S'")
    named = lambda p: F.concat(F.lit(p), F.col("source"))
    span = F.array(F.struct((F.col("doc_id") % 7).cast("int").alias("page_number"), F.col("n_chars").cast("int").alias("start_char"), F.lit(0).alias("end_char")))
    members = d.select(named("set-").alias("artifact_id"), F.col("doc_id").cast("string").alias("member_id"), F.to_json(F.struct("text", span.alias("source_spans"))).alias("payload_json"))
    members = members.withColumn("content_hash", F.sha2("payload_json", 256))
    per = d.groupBy("source").agg(F.count("*").cast("int").alias("n"))
    cited = F.array(F.struct(F.col("n").alias("page_number"), F.col("source").alias("quote")))
    art = lambda p, kind, body, n, k: per.select(named(p).alias("artifact_id"), F.col("source").alias("source_revision_id"), F.lit(kind).alias("artifact_kind"), body.alias("payload_json"), n.alias("member_count"), k.alias("target_count"))
    summary = F.to_json(F.struct(F.concat(F.lit("about "), F.col("n").cast("string")).alias("summary"), cited.alias("citations"), F.array(F.struct(named("set-").alias("artifact_id"))).alias("derived_from")))
    lineage = per.select(named("sum-").alias("artifact_id"), named("set-").alias("input_artifact_id"), F.lit("generated_from").alias("relation"))
    artifacts = art("set-", "paper_chunk_set", F.lit("{}"), F.col("n"), F.col("n")).unionByName(art("sum-", "paper_summary", summary, F.lit(0), F.lit(1)))
    sources = per.select(F.col("source").alias("source_revision_id"), F.lit("http").alias("kind"), F.timestamp_seconds(F.lit(1704067200) + F.col("n")).alias("as_of"))
    return {"artifacts": artifacts, "members": members, "lineage": lineage, "sources": sources}


@registered("""
WITH d AS (SELECT * FROM documents WHERE regexp_matches(text, '\\S'))
SELECT 'artifact-member:set-' || source || ':' || doc_id AS target_id, sha256(text) AS projection_hash FROM d UNION ALL SELECT 'artifact:sum-' || source, sha256('about ' || count(*)) FROM d GROUP BY source""")
def paper_targets(spark, sf_dir):
    p = _paper(spark, sf_dir)
    return projection.paper_targets(p["artifacts"], p["members"]).select("target_id", "projection_hash")


def _library(spark, name: str) -> KnowledgeLibrary:
    return KnowledgeLibrary.open(spark, scratch(spark, name), provider=length_vector, model="length", dimension=2)


@registered(f"""
SELECT 'item:' || doc_id AS target_id, sha256({TEXT} || CASE WHEN doc_id % 10 = 3 THEN ' twice' ELSE '' END) AS projection_hash, length({TEXT}) + CASE WHEN doc_id % 10 = 3 THEN 6 ELSE 0 END AS dim_0 FROM documents WHERE doc_id <> 5 AND (doc_id % 10 <> 3 OR doc_id % 4 = 3)""")
def knowledge_upsert(spark, sf_dir):
    """Items put, some replaced, one deleted: the search records that the store then has. Of what is replaced, theses get another text and all others are left out before."""
    lib = _library(spark, "upsert")
    items = _news(spark, sf_dir).where("item_id % 10 <> 3 or item_type = 'thesis'")
    lib.put_knowledge(items)
    claim = F.get_json_object("payload_json", "$.claim")
    lib.put_knowledge(items.where("item_id % 10 = 3").withColumn("payload_json", F.to_json(F.struct(F.concat(claim, F.lit(" twice")).alias("claim")))))
    if lib.table("items").where("item_id = '5'").limit(1).count():
        lib.delete("5")
    lib.check()
    return lib.table("records").select("target_id", "projection_hash", F.col("embedding")[0].cast("long").alias("dim_0"))


@registered(f"""
WITH x AS (SELECT doc_id, length({TEXT}) AS n, lang, source FROM documents WHERE lang = 'en' AND doc_id % 4 IN (0, 3)),
s AS (SELECT *, round((n * 5.0 + 10000.0) / (sqrt(n * n + 10000.0) * sqrt(25.0 + 10000.0)), 6) AS score, (n * 5.0 + 10000.0) / (sqrt(n * n + 10000.0) * sqrt(25.0 + 10000.0)) AS exact FROM x)
SELECT 'item:' || doc_id AS target_id, score, CASE WHEN doc_id % 4 = 0 THEN 'news' ELSE 'thesis' END AS artifact_kind, 's' AS cited, (doc_id % 9)::INT AS page, lang AS quote FROM s ORDER BY exact DESC, target_id LIMIT 25""")
def knowledge_hits(spark, sf_dir):
    """The store's own search: restrictions, ranking, and evidence with its locator and citations."""
    lib = _library(spark, "hits")
    lib.put_knowledge(_news(spark, sf_dir))
    found = lib.search(SemanticQuery("five5", top_k=25, item_types=("news", "thesis"), tags=("en",)))
    c = F.col("citations")[0]
    return found.select("target_id", F.round("score", 6).alias("score"), "locator.artifact_kind", c["source_id"].alias("cited"), c["page"].alias("page"), c["quote"].alias("quote"))


@registered("""
WITH d AS (SELECT * FROM documents WHERE regexp_matches(text, '\\S')), x AS (
SELECT 'artifact-member:set-' || source || ':' || doc_id AS target_id, least(length(text), 10000000) AS n, 'paper_chunk_set' AS artifact_kind, (doc_id % 7)::INT AS page, n_chars::INT AS char_offset, substr(text, 1, 500) AS quote, source FROM d
UNION ALL SELECT 'artifact:sum-' || source, length('about ' || count(*)), 'paper_summary', count(*)::INT, NULL, source, source FROM d GROUP BY source)
SELECT target_id, artifact_kind, source AS cited, page, char_offset, sha256(quote) AS quote_hash FROM x ORDER BY (n * 5.0 + 10000.0) / (sqrt(n * n::DOUBLE + 10000.0) * sqrt(25.0 + 10000.0)) DESC, target_id LIMIT 30""")
def paper_hits(spark, sf_dir):
    """Summaries and chunks as hits: a chunk cites its spans and its first 500 characters."""
    lib, p = _library(spark, "papers"), _paper(spark, sf_dir)
    lib.put_artifacts(p["artifacts"], p["members"], p["lineage"], None, p["sources"])
    c = F.col("citations")[0]
    return lib.search(SemanticQuery("five5", top_k=30)).select("target_id", "locator.artifact_kind", c["source_id"].alias("cited"), c["page"].alias("page"), c["char_offset"].alias("char_offset"), F.sha2(c["quote"], 256).alias("quote_hash"))


@registered("SELECT 't' || turn AS node_id, turn::INT AS position, role AS title, text AS content FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) UNION ALL SELECT 'root', 0, 'all', NULL")
def structure_trees(spark, sf_dir):
    """A tree stored by itself, opened again and verified."""
    c = t(spark, sf_dir, "conversations")
    c = c.join(c.agg(F.max("conv_id").alias("conv_id")), "conv_id")
    page, none = F.array(F.col("turn").cast("int") + 1), F.array().cast("array<string>")
    name = F.concat(F.lit("t"), F.col("turn").cast("string"))
    leaf = c.select(name.alias("node_id"), F.lit("root").alias("parent_id"), F.col("turn").cast("int").alias("position"), F.col("role").alias("title"), F.lit("").alias("summary"), F.col("text").alias("content"), none.alias("children_ids"), page.alias("pages"))
    kids = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("t"), x.cast("string")))
    root = c.agg(kids.alias("children_ids"), F.array_sort(F.collect_list(F.col("turn").cast("int") + 1)).alias("pages"))
    root = root.select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("position"), F.lit("all").alias("title"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("content"), "children_ids", "pages")
    lib = _library(spark, "structure")
    lib.put_structure("tree", "source", root.unionByName(leaf))
    return lib.open_structure("tree").select("node_id", "position", "title", "content")


@registered("""
SELECT rule, count(*)::BIGINT AS n FROM (
SELECT 'record without item' AS rule FROM lineitem WHERE l_orderkey % 50 = 0
UNION ALL SELECT 'node without item' FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'node count' FROM orders WHERE o_orderkey % 50 = 1
UNION ALL SELECT 'target count' FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 50 = 2
UNION ALL SELECT 'payload hash' FROM orders WHERE o_orderkey % 50 = 3
UNION ALL SELECT 'record of an older item' FROM lineitem WHERE l_orderkey % 50 = 4
UNION ALL SELECT 'node hash' FROM orders WHERE o_orderkey % 50 = 5
UNION ALL SELECT 'projected text' FROM lineitem WHERE l_orderkey % 50 = 6
UNION ALL SELECT 'one dimension' FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 50 = 7 GROUP BY 1 HAVING count(DISTINCT l_linenumber % 2) > 1)) GROUP BY rule""")
def item_violations(spark, sf_dir):
    """Orders as items with one node each and their lines as records; each remainder of 50 breaks one rule."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    key, line = F.col("o_orderkey"), F.col("l_orderkey")
    rem, lrem = key % 50, line % 50
    n = li.groupBy(line.alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    body = F.concat(F.lit('{"o":'), key.cast("string"), F.lit("}"))
    items = o.where(rem != 0).join(n, "o_orderkey", "left").select(
        key.cast("string").alias("item_id"), F.lit("tree").alias("item_shape"), body.alias("payload_json"), F.sha2(F.when(rem == 3, F.lit("other")).otherwise(body), 256).alias("canonical_hash"),
        F.when(rem == 1, 2).otherwise(1).alias("node_count"), (F.coalesce("n", F.lit(0)) + F.when(rem == 2, 1).otherwise(0)).alias("target_count"),
    )
    nodes = o.select(key.cast("string").alias("item_id"), F.lit("root").alias("node_id"), body.alias("payload_json"), F.sha2(F.when(rem == 5, F.lit("other")).otherwise(body), 256).alias("content_hash"))
    own = F.concat(F.lit('{"o":'), line.cast("string"), F.lit("}"))
    right = F.sha2(F.when(lrem == 3, F.lit("other")).otherwise(own), 256)
    vector = F.when((lrem == 7) & (F.col("l_linenumber") % 2 == 1), F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    text = F.col("l_returnflag")
    records = li.select(
        line.cast("string").alias("item_id"), F.concat(F.lit("r"), line.cast("string")).alias("target_id"), text.alias("matched_text"), F.sha2(F.when(lrem == 6, F.lit("other")).otherwise(text), 256).alias("projection_hash"),
        F.when(lrem == 4, "old").otherwise(right).alias("item_canonical_hash"), vector.alias("embedding"),
    )
    return integrity.item_violations(items, nodes, records).groupBy("rule").agg(F.count("*").alias("n"))


@registered("""
SELECT rule, count(*)::BIGINT AS n FROM (
SELECT 'projection without artifact' AS rule FROM orders WHERE o_custkey % 20 = 0
UNION ALL SELECT 'projection without source' FROM orders WHERE o_orderkey % 40 = 7
UNION ALL SELECT 'projection without member' FROM orders WHERE o_orderkey % 40 = 9
UNION ALL SELECT 'member count' FROM customer WHERE c_custkey % 20 = 2
UNION ALL SELECT 'target count' FROM customer WHERE c_custkey % 20 = 3
UNION ALL SELECT 'member hash' FROM orders WHERE o_orderkey % 40 = 11
UNION ALL SELECT 'projected text' FROM orders WHERE o_orderkey % 40 = 13
UNION ALL SELECT 'input without artifact' FROM customer WHERE c_custkey % 20 = 4
UNION ALL SELECT 'asset hash' FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT 'asset without source' FROM nation WHERE n_nationkey % 5 = 2) GROUP BY rule""")
def artifact_violations(spark, sf_dir):
    """Customers as artifacts, their orders as members and projections; remainders break one rule each."""
    c, o, n = (t(spark, sf_dir, name) for name in ("customer", "orders", "nation"))
    own, rem = F.col("c_custkey"), F.col("o_orderkey") % 40
    k = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("int").alias("k"), F.count_if(rem != 9).cast("int").alias("m"))
    name, order = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    artifacts = c.where(own % 20 != 0).join(k, "c_custkey", "left").select(
        own.cast("string").alias("artifact_id"), (F.coalesce("m", F.lit(0)) + F.when(own % 20 == 2, 1).otherwise(0)).alias("member_count"), (F.coalesce("k", F.lit(0)) + F.when(own % 20 == 3, 1).otherwise(0)).alias("target_count")
    )
    members = o.where(rem != 9).select(name.alias("artifact_id"), order.alias("member_id"), order.alias("payload_json"), F.sha2(F.when(rem == 11, F.lit("other")).otherwise(order), 256).alias("content_hash"))
    projections = o.select(name.alias("artifact_id"), order.alias("target_id"), order.alias("member_id"), F.when(rem == 7, "none").otherwise("s").alias("source_revision_id"), order.alias("matched_text"), F.sha2(F.when(rem == 13, F.lit("other")).otherwise(order), 256).alias("projection_hash"))
    lineage = c.where(own % 20 > 3).select(own.cast("string").alias("artifact_id"), F.when(own % 20 == 4, "none").otherwise(own.cast("string")).alias("input_artifact_id"))
    blob, nrem = F.encode("n_name", "UTF-8"), F.col("n_nationkey") % 5
    assets = n.select(F.when(nrem == 2, "none").otherwise("s").alias("source_revision_id"), F.col("n_nationkey").cast("string").alias("asset_id"), blob.alias("blob"), F.sha2(F.when(nrem == 1, F.encode(F.lit("other"), "UTF-8")).otherwise(blob), 256).alias("content_hash"))
    sources = spark.createDataFrame([("s",)], "source_revision_id string")
    return integrity.artifact_violations(sources, artifacts, members, projections, lineage, assets).groupBy("rule").agg(F.count("*").alias("n"))


@registered("SELECT artifact_kind, artifact_id, payload FROM (SELECT 'paper_summary' AS artifact_kind, 'sum-' || source AS artifact_id, 'about ' || count(*) AS payload FROM documents WHERE regexp_matches(text, '\\S') GROUP BY source) UNION ALL SELECT 'member', 'set-' || source, sha256(text) FROM documents WHERE regexp_matches(text, '\\S')")
def locators(spark, sf_dir):
    """Locators of summaries and of chunks, resolved to what they name."""
    lib, p = _library(spark, "locators"), _paper(spark, sf_dir)
    lib.put_artifacts(p["artifacts"], p["members"], p["lineage"], None, p["sources"])
    base = lib.table("artifacts").select("source_revision_id", "artifact_kind", "artifact_id")
    whole = base.where("artifact_kind = 'paper_summary'").withColumn("member_id", F.lit(None).cast("string"))
    part = base.join(lib.table("members").select("artifact_id", "member_id"), "artifact_id").select(*whole.columns)
    found = lib.resolve(whole.unionByName(part))
    summary, text = (F.get_json_object("payload_json", f"$.{x}") for x in ("summary", "text"))
    named = F.col("member_id").isNotNull()
    return found.select(F.when(named, "member").otherwise(F.col("artifact_kind")).alias("artifact_kind"), "artifact_id", F.when(named, F.sha2(text, 256)).otherwise(summary).alias("payload"))


@registered("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 3 THEN 'a record number needs a resolver of open documents' WHEN 4 THEN 'text has no pages' WHEN 5 THEN 'not a document with pages: text/html' END AS error,
 CASE s_suppkey % 6 WHEN 0 THEN '2024-01-02 00:00:00' WHEN 1 THEN '2024-01-01 00:00:00' ELSE '2024-01-03 00:00:00' END AS available, sha256(s_name) AS content_hash FROM supplier""")
def paper_sources(spark, sf_dir):
    """Sources by kind: which are refused, and when the others were available."""
    from ..sources.papers import acquire

    s, rem = t(spark, sf_dir, "supplier"), F.col("s_suppkey") % 6
    kind = F.element_at(F.array(*map(F.lit, ("arxiv", "arxiv", "local", "doi", "text", "http"))), (rem + 1).cast("int"))
    day = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    src = s.select(
        F.col("s_suppkey").cast("string").alias("uri"), F.lit(None).cast("string").alias("resolved_uri"), kind.alias("kind"), F.when(rem == 5, "text/html").otherwise("Application/PDF").alias("content_type"), F.encode("s_name", "UTF-8").alias("body"),
        day(3).alias("fetched_at"), F.when(rem < 3, day(1)).alias("published_at"), F.when(rem == 0, day(2)).alias("updated_at"), F.lit(None).cast("string").alias("arxiv_id"), F.lit("t").alias("title"), F.array().cast("array<string>").alias("authors"),
    )
    got = acquire(src)
    return got.select(F.col("uri").cast("long").alias("s_suppkey"), "error", F.date_format(time.to_utc(F.col("available_at")), "yyyy-MM-dd HH:mm:ss").alias("available"), "content_hash")


@registered("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 16 AS r, c_name FROM customer), o AS (SELECT c.k, r, o_orderkey AS m FROM orders JOIN c ON c.k = o_custkey)
SELECT rule, count(*)::BIGINT AS n FROM (
SELECT 'source payload missing' AS rule FROM c WHERE r = 1 UNION ALL SELECT 'source payload hash' FROM c WHERE r = 2 UNION ALL SELECT 'asset count' FROM c WHERE r = 3
UNION ALL SELECT 'asset set' FROM c WHERE r IN (1, 4) UNION ALL SELECT 'asset size' FROM c WHERE r = 5 UNION ALL SELECT 'asset bytes' FROM c WHERE r = 6
UNION ALL SELECT 'lineage set' FROM c WHERE r IN (7, 15) UNION ALL SELECT 'summary without lineage' FROM c WHERE r = 8 UNION ALL SELECT 'unknown input' FROM c WHERE r = 9
UNION ALL SELECT 'projected set' FROM c WHERE r = 10 UNION ALL SELECT 'artifact hash' FROM c WHERE r = 11
UNION ALL SELECT 'repeated key in members' FROM o WHERE r = 12 UNION ALL SELECT 'no key in members' FROM o WHERE r = 13) GROUP BY rule""")
def store_gates(spark, sf_dir):
    """A source with an asset, a chunk set of its orders and a summary for each customer; each remainder of 16 breaks one gate that a put goes through."""
    from ..operators import library

    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    r, own = F.col("c_custkey") % 16, F.col("c_custkey").cast("string")
    blob = F.encode("c_name", "UTF-8")
    asset = c.select(
        own.alias("source_revision_id"), F.concat(F.lit("a"), own).alias("asset_id"), F.lit("figure").alias("kind"), F.lit(1).alias("page_number"), F.lit("image/png").alias("media_type"), blob.alias("blob"), r.alias("r"),
        F.when(r == 6, "x").otherwise(F.sha2(blob, 256)).alias("content_hash"), (F.octet_length(blob) + F.when(r == 5, 1).otherwise(0)).cast("long").alias("size_bytes"),
    )
    none = F.lit(None).cast("string")
    bare = c.select(own.alias("source_revision_id"), F.col("c_name").alias("title"), none.alias("payload_json"), none.alias("canonical_hash"), F.lit(None).cast("int").alias("asset_count"))
    sources = library.with_payload(bare, asset)
    rem = F.col("source_revision_id").cast("long") % 16
    sources = sources.select("source_revision_id", F.when(rem != 1, F.col("payload_json")).alias("payload_json"), F.when(rem == 2, "x").otherwise(F.col("canonical_hash")).alias("canonical_hash"), F.when(rem == 3, 2).otherwise(F.col("asset_count")).alias("asset_count"))
    assets = asset.withColumn("media_type", F.when(F.col("r") == 4, "image/gif").otherwise(F.col("media_type"))).drop("r")
    held = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    order, cust, orem = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_custkey") % 16
    members = held.select(F.when(orem != 13, F.concat(F.lit("set"), cust)).alias("artifact_id"), order.alias("member_id"), none.alias("parent_id"), F.lit(0).alias("position"), F.to_json(F.struct(order.alias("text"))).alias("payload_json"), orem.alias("r"))
    members = members.unionByName(members.where("r = 12")).withColumn("content_hash", F.sha2("payload_json", 256)).drop("r")
    inputs = F.when(r != 8, F.array(F.struct(F.when(r == 9, "zz").otherwise(F.concat(F.lit("set"), own)).alias("artifact_id"))))
    art = lambda p, kind, body: c.select(F.concat(F.lit(p), own).alias("artifact_id"), own.alias("source_revision_id"), F.lit(kind).alias("artifact_kind"), body.alias("payload_json"))
    plain = art("set", "paper_chunk_set", F.lit("{}")).unionByName(art("sum", "paper_summary", F.to_json(F.struct(own.alias("summary"), inputs.alias("derived_from")))))
    each = members.groupBy("artifact_id").agg(library._members_digest().alias("h"))
    of = library._artifact_hash(F.col("payload_json"), F.col("h"))
    artifacts = plain.join(each, "artifact_id", "left").withColumn("canonical_hash", F.when((F.col("source_revision_id") % 16 == 11) & (F.col("artifact_kind") == "paper_summary"), "x").otherwise(of))
    lineage = c.where((r != 7) & (r != 8)).select(F.concat(F.lit("sum"), own).alias("artifact_id"), F.when(r == 9, "zz").otherwise(F.concat(F.lit("set"), own)).alias("input_artifact_id"), F.when(r == 15, "other").otherwise("generated_from").alias("relation"))
    targets = projection.paper_targets(artifacts, members)
    stored = targets.where("not (source_revision_id % 16 = 10 and member_id is null)")
    found = [
        integrity.source_violations(sources, assets), integrity.lineage_violations(artifacts, lineage, artifacts), integrity.projection_violations(targets, stored), library.wrong_hashes(artifacts, members),
        integrity.repeated_keys(members, ["artifact_id", "member_id"], "members"),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.count("*").alias("n"))


BM25 = """
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok), q AS (SELECT unnest(['stupid','trash','license']) AS term),
tf AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS f FROM tok, q),
df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@registered(BM25)
def bm25_indexed(spark, sf_dir):
    """The same from a stored index, into which the documents come in two parts."""
    index = text_index.TextIndex.open(spark, scratch(spark, "index"))
    docs = t(spark, sf_dir, "documents")
    for part in (F.col("lang") == "en", F.col("lang") != "en"):
        index.add(docs.where(part))
    return index.search("stupid trash license", 20).withColumnRenamed("key", "doc_id")
