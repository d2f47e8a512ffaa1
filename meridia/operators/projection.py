"""What of the store can be searched, and what a hit shows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import target_id
from ..functions.text import strip

PROJECTION_VERSION = "1"
QUOTE = 500

CITATION = "struct<source_id:string,page:int,char_offset:int,quote:string>"
#: what projections and hits read of payloads
PAYLOAD = (
    "struct<headline:string,event_type:string,entities:array<string>,ticker:string,period:string,guidance:string,factor_name:string,universe:string,claim:string,"
    f"title:string,summary:string,text:string,citations:array<struct<source_id:string,page:int,page_number:int,char_offset:int,quote:string>>,"
    "source_spans:array<struct<page_number:int,start_char:int,end_char:int>>>"
)


def is_extracted(c: Column) -> Column:
    """Whether the payload (JSON) says how a model extracted it; items made by hand do not."""
    return F.get_json_object(c, "$.extraction").isNotNull()


def payload(c: Column) -> Column:
    return F.from_json(c, PAYLOAD)


def knowledge_text(item_type: Column, p: Column) -> Column:
    """The searchable text of a flat item, by its type; null for a type without one."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    entities = F.array_join(F.coalesce(p["entities"], F.array().cast("array<string>")), ", ")
    news = strip(F.concat(blank(p["headline"]), F.lit("\n"), blank(p["event_type"]), F.lit("\n"), entities))
    earnings = strip(F.concat(blank(p["ticker"]), F.lit(" "), blank(p["period"]), F.lit(" earnings\n"), blank(p["guidance"])))
    factor = F.concat(F.lit("factor "), blank(p["factor_name"]), F.lit(" on "), F.coalesce(F.nullif(p["universe"], F.lit("")), F.lit("unspecified")))
    return F.when(item_type == "news", news).when(item_type == "earnings", earnings).when(item_type == "factor", factor).when(item_type == "thesis", p["claim"])


def node_text(p: Column) -> Column:
    return F.concat(F.coalesce(p["title"], F.lit("")), F.lit("\n"), F.coalesce(p["summary"], F.lit("")))


def _target(df: DataFrame, text: Column) -> DataFrame:
    out = df.withColumn("matched_text", F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.raise_error(F.lit("a searchable text must not be empty"))))
    return out.withColumn("projection_hash", F.sha2("matched_text", 256))


def search_targets(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target_id, item_id, node_id, item_type, tree_id, matched_text, projection_hash): one row a flat item; of a tree its root and every other node.

    An item without text, or a tree without its root, is an error.
    """
    tree = F.col("item_shape") == "tree"
    root = nodes.where("parent_id is null").select("item_id", payload(F.col("payload_json")).alias("root"))
    whole = items.select("item_id", "item_type", "item_shape", "payload_json").join(root, "item_id", "left")
    text = F.when(tree, node_text(F.col("root"))).otherwise(knowledge_text(F.col("item_type"), payload(F.col("payload_json"))))
    none = F.lit(None).cast("string")
    first = _target(whole.select("item_id", none.alias("node_id"), "item_type", F.when(tree, F.col("item_id")).alias("tree_id"), F.when(~tree | F.col("root").isNotNull(), text).alias("t")), F.col("t"))
    rest = nodes.where("parent_id is not null").join(items.where(tree).select("item_id", "item_type"), "item_id")
    rest = _target(rest.select("item_id", "node_id", "item_type", F.col("item_id").alias("tree_id"), node_text(payload(F.col("payload_json"))).alias("t")), F.col("t"))
    return first.unionByName(rest).withColumn("target_id", target_id(F.col("item_id"), F.col("node_id"))).drop("t")


def paper_targets(artifacts: DataFrame, members: DataFrame) -> DataFrame:
    """(target_id, artifact_id, member_id, source_revision_id, matched_text, projection_hash) of summaries and of the chunks of chunk sets.

    A chunk set itself is not searched; a blank summary or chunk is an error.
    """
    p = payload(F.col("payload_json"))
    shown = lambda c: F.when(strip(c) != "", c)
    none = F.lit(None).cast("string")
    whole = artifacts.where("artifact_kind = 'paper_summary'").select("artifact_id", none.alias("member_id"), "source_revision_id", shown(p["summary"]).alias("t"))
    sets = artifacts.where("artifact_kind = 'paper_chunk_set'").select("artifact_id", "source_revision_id")
    chunks = members.join(sets, "artifact_id").select("artifact_id", "member_id", "source_revision_id", shown(p["text"]).alias("t"))
    out = _target(whole.unionByName(chunks), F.col("t")).drop("t")
    name = F.when(F.col("member_id").isNull(), F.concat(F.lit("artifact:"), "artifact_id")).otherwise(F.concat(F.lit("artifact-member:"), "artifact_id", F.lit(":"), "member_id"))
    return out.withColumn("target_id", name)


def citations(kind: Column, p: Column, source: Column) -> Column:
    """Citations of what a target shows: those of the payload; of a chunk its spans, with the first characters as the quote."""
    own = F.transform(
        F.coalesce(p["citations"], F.array().cast("array<struct<source_id:string,page:int,page_number:int,char_offset:int,quote:string>>")),
        lambda c: F.struct(F.coalesce(c["source_id"], source).alias("source_id"), F.coalesce(c["page"], c["page_number"]).alias("page"), c["char_offset"].alias("char_offset"), c["quote"].alias("quote")),
    )
    spans = F.zip_with(
        p["source_spans"],
        F.array_repeat(F.substring(p["text"], 1, QUOTE), F.size(p["source_spans"])),
        lambda s, q: F.struct(source.alias("source_id"), s["page_number"].alias("page"), s["start_char"].alias("char_offset"), q.alias("quote")),
    )
    return F.when(kind == "paper_chunk_set", spans).otherwise(own).cast(f"array<{CITATION}>")


def hits(top: DataFrame, items: DataFrame, nodes: DataFrame, artifacts: DataFrame, members: DataFrame) -> DataFrame:
    """Ranked index rows as evidence: locator, projection, times, source and citations; best first.

    The few rows that are left of a search (they are broadcast) fetch their
    canonical payload; one without it is an error.
    """
    few = F.broadcast(top)  # top_k rows
    paper = F.col("source_revision_id").isNotNull()
    owner = items.select("item_id", F.col("payload_json").alias("item_payload")).unionByName(artifacts.select(F.col("artifact_id").alias("item_id"), F.col("payload_json").alias("item_payload")))
    part = nodes.select("item_id", "node_id", F.col("payload_json").alias("node_payload")).unionByName(members.select(F.col("artifact_id").alias("item_id"), F.col("member_id").alias("node_id"), F.col("payload_json").alias("node_payload")))
    root = nodes.where("parent_id is null").select("item_id", F.col("payload_json").alias("root_payload"))
    keys = top.select("item_id").distinct()
    owner, part, root = (df.join(F.broadcast(keys), "item_id", "left_semi") for df in (owner, part, root))
    got = few.join(owner, "item_id", "left").join(part, ["item_id", "node_id"], "left").join(root, "item_id", "left")
    canonical = F.when(F.col("node_id").isNotNull(), F.col("node_payload")).otherwise(F.coalesce("root_payload", "item_payload"))
    checked = F.when(F.col("item_payload").isNotNull() & canonical.isNotNull(), canonical).otherwise(F.raise_error(F.concat(F.lit("stale index data for target "), F.col("target_id"))))
    got = got.withColumn("_p", payload(checked))
    return got.select(
        "target_id",
        F.struct("source_revision_id", F.col("item_id").alias("artifact_id"), "artifact_kind", F.col("node_id").alias("member_id")).alias("locator"),
        F.struct(F.lit("text_embedding").alias("kind"), F.col("projection_schema_version").alias("version"), F.col("embedding_model").alias("model"), F.col("dimension").alias("dimensions"), F.col("projection_hash").alias("content_hash")).alias("projection"),
        "item_id", "node_id", "item_type", "score", "matched_text", "as_of", "available_at", "source_kind",
        citations(F.when(paper, F.col("artifact_kind")), F.col("_p"), F.col("source_revision_id")).alias("citations"),
    ).orderBy(F.desc("score"), "target_id")
