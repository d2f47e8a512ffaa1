"""Relational integrity of a knowledge store, as one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StaleStoreError(RuntimeError):
    """Stored tables disagree with each other; ``violations`` has the first of them, if rules were broken."""

    def __init__(self, message: str, violations: tuple = ()):
        super().__init__(message)
        self.violations = violations


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the child table whose key the parent lacks; rows with a null key are none."""
    keys = parent.select(*on).distinct()
    return child.dropna(subset=on).join(keys, on, "left_anti")


def contiguous(rows: DataFrame, group: str, position: str, first: int = 0) -> DataFrame:
    """(group, n, lowest, highest, kinds) of the groups whose positions are not first, first + 1, ..."""
    got = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(position).alias("lowest"), F.max(position).alias("highest"), F.countDistinct(position).alias("kinds"))
    return got.where((F.col("lowest") != first) | (F.col("highest") != F.col("n") - 1 + first) | (F.col("kinds") != F.col("n")))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one side has and the other lacks; empty where both are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def _rule(df: DataFrame, rule: str, key: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def item_violations(items: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Items against their nodes and search records. Each side is counted before it is joined, so nothing multiplies; a side is joined once for all rules that need the join.

    The hash that a record has of its item goes through the shuffle as 128 bits of its own SHA-256: 16 bytes, not 64.
    """
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    n = nodes.groupBy("item_id").agg(F.count("*").alias("n"))
    r = records.groupBy("item_id").agg(F.count("*").alias("r"), F.countDistinct(F.size("embedding")).alias("dims"))
    counted = items.select("item_id", "item_shape", "node_count", "target_count").join(n, "item_id", "left").join(r, "item_id", "left").fillna(0, ["n", "r"])
    flat = F.col("item_shape") == "flat"
    wrong_nodes = (F.col("n") != F.col("node_count")) | (flat & (F.col("n") > 0)) | (~flat & (F.col("n") == 0))
    broken = lambda wrong, rule, detail: F.when(wrong, F.struct(F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail")))
    counts = F.array_compact(F.array(broken(wrong_nodes, "node count", "n"), broken(F.col("r") != F.col("target_count"), "target count", "r"), broken(F.col("dims") > 1, "one dimension", "dims")))
    held = items.select("item_id", short("canonical_hash").alias("canonical_hash"), F.lit(True).alias("known"))
    of = records.where("item_id is not null").select("item_id", "target_id", short("item_canonical_hash").alias("item_canonical_hash")).join(held, "item_id", "left")
    older = F.when(F.col("known").isNull(), "record without item").when(F.col("item_canonical_hash") != F.col("canonical_hash"), "record of an older item")
    parts = [
        of.select(older.alias("rule"), F.col("item_id").cast("string").alias("key"), F.col("target_id").cast("string").alias("detail")).where("rule is not null"),
        counted.select("item_id", F.explode(counts).alias("x")).select("x.rule", F.col("item_id").cast("string").alias("key"), "x.detail"),
        _rule(orphans(nodes, items, ["item_id"]), "node without item", "item_id", F.col("node_id")),
        _rule(items.where(F.sha2("payload_json", 256) != F.col("canonical_hash")), "payload hash", "item_id", F.col("canonical_hash")),
        _rule(nodes.where(F.sha2("payload_json", 256) != F.col("content_hash")), "node hash", "item_id", F.col("node_id")),
        _rule(records.where(F.sha2("matched_text", 256) != F.col("projection_hash")), "projected text", "item_id", F.col("target_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def artifact_violations(sources: DataFrame, artifacts: DataFrame, members: DataFrame, projections: DataFrame, lineage: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Artifacts against their sources, members, projections, inputs and assets."""
    m = members.groupBy("artifact_id").agg(F.countDistinct("member_id").alias("m"))
    p = projections.groupBy("artifact_id").agg(F.countDistinct("target_id").alias("p"))
    counted = artifacts.join(m, "artifact_id", "left").join(p, "artifact_id", "left").fillna(0, ["m", "p"])
    named = projections.where("member_id is not null")
    parts = [
        _rule(orphans(projections, artifacts, ["artifact_id"]), "projection without artifact", "artifact_id", F.col("target_id")),
        _rule(orphans(projections, sources, ["source_revision_id"]), "projection without source", "artifact_id", F.col("target_id")),
        _rule(orphans(named, members, ["artifact_id", "member_id"]), "projection without member", "artifact_id", F.col("target_id")),
        _rule(members.where(F.sha2("payload_json", 256) != F.col("content_hash")), "member hash", "artifact_id", F.col("member_id")),
        _rule(projections.where(F.sha2("matched_text", 256) != F.col("projection_hash")), "projected text", "artifact_id", F.col("target_id")),
        _rule(counted.where("m <> member_count"), "member count", "artifact_id", F.col("m")),
        _rule(counted.where("p <> target_count"), "target count", "artifact_id", F.col("p")),
        _rule(orphans(lineage.withColumnRenamed("artifact_id", "of").withColumnRenamed("input_artifact_id", "artifact_id"), artifacts, ["artifact_id"]), "input without artifact", "of", F.col("artifact_id")),
    ]
    if assets is not None:
        parts += [
            _rule(assets.where(F.sha2("blob", 256) != F.col("content_hash")), "asset hash", "source_revision_id", F.col("asset_id")),
            _rule(orphans(assets, sources, ["source_revision_id"]), "asset without source", "source_revision_id", F.col("asset_id")),
        ]
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(df: DataFrame, identity: list[str], table: str) -> DataFrame:
    """Rows that share what identifies them, or lack its first column."""
    rule = lambda what: F.lit(f"{what} in {table}").alias("rule")
    name = F.concat_ws(":", *identity).alias("key")
    twice = df.groupBy(*identity).agg(F.count("*").alias("n")).where("n > 1").select(rule("repeated key"), name, F.col("n").cast("string").alias("detail"))
    return twice.unionByName(df.where(F.col(identity[0]).isNull()).select(rule("no key"), name, F.lit(None).cast("string").alias("detail")))


def multiset(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """(key, n, a, b): an order-free digest of each key's rows; tasks send one row a key, whatever number of rows it has."""
    row = F.to_json(F.struct(*columns))
    got = df.select(key, F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.xxhash64(F.reverse(row)).cast("decimal(38,0)").alias("b"))
    return got.groupBy(key).agg(F.count("*").alias(f"{prefix}n"), F.sum("a").alias(f"{prefix}a"), F.sum("b").alias(f"{prefix}b"))


def unequal_sets(expected: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, expected, stored) with the numbers of rows, for each key whose rows differ as multisets between both sides."""
    both = multiset(expected, key, columns, "e").join(multiset(stored, key, columns, "s"), key, "full")
    same = F.col("ea").eqNullSafe(F.col("sa")) & F.col("eb").eqNullSafe(F.col("sb")) & F.col("en").eqNullSafe(F.col("sn"))
    return both.where(~same).select(key, F.coalesce("en", F.lit(0)).alias("expected"), F.coalesce("sn", F.lit(0)).alias("stored"))


ASSET = ["asset_id", "kind", "page_number", "media_type", "content_hash", "size_bytes"]
_ASSET = "assets array<struct<asset_id:string,kind:string,page_number:int,media_type:string,content_hash:string,size_bytes:bigint>>"


def source_violations(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Sources against their canonical payload, and their assets against what the payload lists: number, identity and facts of each, size and hash of its bytes."""
    n = assets.groupBy("source_revision_id").agg(F.count("*").alias("n"))
    counted = sources.join(n, "source_revision_id", "left").fillna(0, ["n"])
    listed = sources.select("source_revision_id", F.explode(F.from_json("payload_json", _ASSET)["assets"]).alias("x")).select("source_revision_id", "x.*")
    stored = assets.join(sources.select("source_revision_id"), "source_revision_id", "left_semi")
    sets = unequal_sets(listed, stored, "source_revision_id", ASSET)
    parts = [
        _rule(sources.where("payload_json is null or canonical_hash is null"), "source payload missing", "source_revision_id", F.lit(None)),
        _rule(sources.where(F.sha2("payload_json", 256) != F.col("canonical_hash")), "source payload hash", "source_revision_id", F.col("canonical_hash")),
        _rule(counted.where("n <> coalesce(asset_count, 0)"), "asset count", "source_revision_id", F.col("n")),
        _rule(sets, "asset set", "source_revision_id", F.col("stored")),
        _rule(assets.where(F.octet_length("blob") != F.col("size_bytes")), "asset size", "source_revision_id", F.col("asset_id")),
        _rule(assets.where(F.sha2("blob", 256) != F.col("content_hash")), "asset bytes", "source_revision_id", F.col("asset_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def lineage_violations(artifacts: DataFrame, lineage: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs as summaries name them (derived_from) against those that are stored; inputs are artifacts that are known."""
    named = F.explode(F.from_json("payload_json", "derived_from array<struct<artifact_id:string>>")["derived_from"])
    expected = artifacts.where("artifact_kind = 'paper_summary'").select("artifact_id", named.alias("x")).select("artifact_id", F.col("x.artifact_id").alias("input_artifact_id"), F.lit("generated_from").alias("relation"))
    sets = unequal_sets(expected.distinct(), lineage, "artifact_id", ["input_artifact_id", "relation"])
    bare = artifacts.where("artifact_kind = 'paper_summary'").join(expected.select("artifact_id").distinct(), "artifact_id", "left_anti")
    inputs = lineage.select("artifact_id", F.col("input_artifact_id").alias("of"))
    lost = inputs.join(known.select(F.col("artifact_id").alias("of")).distinct(), "of", "left_anti")
    return _rule(sets, "lineage set", "artifact_id", F.col("stored")).unionByName(_rule(bare, "summary without lineage", "artifact_id", F.lit(None))).unionByName(_rule(lost, "unknown input", "artifact_id", F.col("of")))


def projection_violations(expected: DataFrame, projections: DataFrame) -> DataFrame:
    """Projections that artifacts must have (target_id, artifact_id, projection_hash) against those that are stored, as sets."""
    sets = unequal_sets(expected, projections, "artifact_id", ["target_id", "projection_hash"])
    return _rule(sets, "projected set", "artifact_id", F.col("stored"))


def dimensions(records: DataFrame) -> tuple[int, int] | None:
    """The smallest and the largest number of components of stored vectors; None without any."""
    got = records.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    return None if got["lo"] is None else (got["lo"], got["hi"])


def require_none(violations: DataFrame) -> None:
    """Fails closed: raises on the first violations, at most 20 of them."""
    if first := violations.limit(20).collect():
        raise StaleStoreError(f"{first[0]['rule']}: {first[0]['key']} ({first[0]['detail']})", tuple(first))
