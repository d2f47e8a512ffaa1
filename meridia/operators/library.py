"""A versioned store of knowledge: snapshots, upserts, deletes, search.

Tables are layers (``layers.LayeredTables``): a put or delete writes its own
rows and the keys it replaces, not the tables. What a change writes passes the
integrity gates before it is published; since it replaces whole items and
artifacts, a store whose changes have all passed is whole, and ``check`` has
nothing to read. A change that began with a version that is no longer the
newest when it is published fails with ``ConflictError``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import STORE
from . import integrity, projection
from .layers import SCHEMA_VERSION, ConflictError, LayeredTables  # noqa: F401 (callers catch ConflictError)
from .providers import embed, hashed_embedding
from .search import SemanticQuery, matching, rank, stale

KEYS = {
    "items": "item_id", "nodes": "item_id", "records": "item_id", "sources": "source_revision_id", "assets": "source_revision_id",
    "artifacts": "artifact_id", "members": "artifact_id", "lineage": "artifact_id", "projections": "artifact_id",
}
IDENTITY = {
    "items": ["item_id"], "nodes": ["item_id", "node_id"], "records": ["target_id"], "sources": ["source_revision_id"], "assets": ["asset_id"],
    "artifacts": ["artifact_id"], "members": ["artifact_id", "member_id"], "lineage": ["artifact_id", "input_artifact_id", "relation"], "projections": ["target_id"],
}
ITEM, ARTIFACT = ("items", "nodes", "records"), ("artifacts", "members", "lineage", "projections")
TREE = "paper_structure_tree"
#: what makes a stored vector stale when it differs
COMPARED = ["embedding_model", "projection_hash", "source_content_hash", "knowledge_schema_version", "projection_schema_version", "dimension"]


class KnowledgeLibrary:
    def __init__(self, spark: SparkSession, root: str, provider: Callable[[str], list[float]] = hashed_embedding, model: str = "hashed", dimension: int = 64, buckets: int = 16):
        self.spark, self.root, self.closed = spark, root.rstrip("/"), False
        self.provider, self.model, self.dimension = provider, model, dimension
        self.tables = LayeredTables(spark, root, STORE, KEYS, buckets)

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> "KnowledgeLibrary":
        """Opens, migrates or creates. A store of an unknown schema version, and one that has lost its manifests, are refused. ``buckets`` holds for a new store; an old one has its own."""
        lib = cls(spark, root, **options)
        tables, names = lib.tables, lib.tables.names()
        if not tables.numbers():
            if "CURRENT.json" in names:
                old = json.loads(tables.read_file("CURRENT.json"))
                if old["schema_version"] != 1:
                    raise RuntimeError(f"schema version {old['schema_version']} is not supported")
                lib._migrate(old | {"next": old["version"] + 1})
            elif any(re.match(r"v\d+-", n) for n in names):
                raise integrity.StaleStoreError(f"{root} has tables but no manifest")
            else:
                tables.publish({"next": 1, "tables": {}, "buckets": tables.buckets, "dimension": {}, "checked": True})
        now = tables.latest()
        if now["schema_version"] == 2:
            lib._migrate(now)
            now = tables.latest()
        if now["schema_version"] != SCHEMA_VERSION:
            raise RuntimeError(f"schema version {now['schema_version']} is not supported")
        tables.buckets = now["buckets"]
        return lib

    def _migrate(self, old: dict) -> None:
        """From versions 1 and 2, which had a path for each table: each is one layer, and columns that it lacks are null."""
        layers = {n: {"rows": [{"n": 0, "path": path, "plain": True}], "gone": []} for n, path in old["tables"].items()}
        self.tables.publish({"next": old["next"], "tables": layers, "buckets": self.tables.buckets, "dimension": {}, "checked": False})

    def _at(self) -> dict:
        """The version that a change or a read begins with."""
        if self.closed:
            raise RuntimeError("the library is closed")
        return self.tables.latest()

    def _checked(self, name: str, df: DataFrame) -> DataFrame:
        schema = STORE[name]
        if extra := set(df.columns) - set(schema.names):
            raise ValueError(f"{name} has no columns {sorted(extra)}")
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    @property
    def version(self) -> int:
        return self.tables.latest()["version"]

    def table(self, name: str) -> DataFrame:
        return self.tables.table(name, self._at())

    def _write(self, at: dict, folder: str, new: dict[str, DataFrame]) -> dict[str, str]:
        return self.tables.write_all({n: self._checked(n, df) for n, df in new.items()}, folder)

    def _layer(self, name: str, path: str) -> DataFrame:
        return self.tables.layer(name, {"path": path}).select(*STORE[name].names)

    def _dimension(self, at: dict, after: dict, name: str, new: DataFrame) -> dict:
        """One dimension for all vectors of a table. What is stored is read only if the new ones differ from it."""
        if (got := integrity.dimensions(new)) is None:
            return after
        if got[0] == got[1] and at["dimension"].get(name) not in (None, got[0]):
            got = integrity.dimensions(self.tables.table(name, after))
        if got[0] != got[1]:
            raise integrity.StaleStoreError(f"one dimension: {name} would have vectors of {got[0]} and {got[1]} components")
        return after | {"dimension": at["dimension"] | {name: got[0]}}

    def _repeated(self, rows: dict[str, DataFrame]) -> list[DataFrame]:
        return [integrity.repeated_keys(df, IDENTITY[n], n) for n, df in rows.items()]

    def _overwrite(self, name: str, df: DataFrame) -> None:
        """Another table in place of the stored one, past all gates; the version counts as unchecked."""
        at = self._at()
        path = self._write(at, self.tables.folder(at), {name: df})[name]
        self.tables.publish(self.tables.changed(at | {"tables": {n: e for n, e in at["tables"].items() if n != name}, "checked": False}, {name: path}))

    def _embedded(self, targets: DataFrame, stored: DataFrame) -> DataFrame:
        """Targets with vectors: the stored one where nothing that matters changed, a new one elsewhere."""
        targets = targets.withColumn("embedding_model", F.lit(self.model)).withColumn("dimension", F.lit(self.dimension)).withColumn("projection_schema_version", F.lit(projection.PROJECTION_VERSION))
        compared = [c for c in COMPARED if c in targets.columns]
        fresh = stale(targets, stored, "target_id", compared)
        kept = targets.join(fresh.select("target_id"), "target_id", "left_anti").join(stored.select("target_id", "embedding"), "target_id")
        return kept.unionByName(fresh.withColumn("embedding", embed(F.col("matched_text"), self.provider)).select(*kept.columns))

    def records_of(self, items: DataFrame, nodes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
        """Search records of items, with the vectors that the store (or ``stored``, a part of it) has of unchanged ones.

        items may have, besides the store's columns, the metadata that records
        carry: as_of, available_at, source_kind, confidence, tags, source_content_hash.
        """
        meta = [c for c in ("as_of", "available_at", "source_kind", "confidence", "tags", "source_content_hash") if c in items.columns]
        own = items.select("item_id", F.col("schema_version").alias("knowledge_schema_version"), F.col("canonical_hash").alias("item_canonical_hash"), *meta)
        targets = projection.search_targets(items, nodes).join(own, "item_id")
        if "source_content_hash" not in meta:
            targets = targets.withColumn("source_content_hash", F.lit(None).cast("string"))
        return self._embedded(targets, self.table("records") if stored is None else stored)

    def put_knowledge(self, items: DataFrame, nodes: DataFrame | None = None) -> None:
        """Replaces items with their nodes, and projects and embeds what can be searched; unchanged targets keep their vectors.

        items: item_id, knowledge_class, item_type, item_shape (flat or tree), schema_version, payload_json, and
        the metadata of ``records_of``; nodes: item_id, node_id, parent_id, position, payload_json.
        """
        at = self._at()
        nodes = self._checked("nodes", nodes if nodes is not None else self.spark.createDataFrame([], STORE["nodes"]))
        nodes = nodes.withColumn("content_hash", F.sha2("payload_json", 256))
        n = nodes.groupBy("item_id").agg(F.count("*").cast("int").alias("node_count"))
        items = items.drop("node_count", "target_count", "canonical_hash").join(n, "item_id", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))
        items = items.withColumn("canonical_hash", F.sha2("payload_json", 256)).withColumn("target_count", F.when(F.col("item_shape") == "tree", F.greatest("node_count", F.lit(1))).otherwise(1))
        stored = self.tables.table("records", at, self.tables.touched(items, "item_id"))
        records = self.records_of(items, nodes, stored)
        self._put_items(at, items.select(*[c for c in items.columns if c in STORE["items"].names]), nodes, records)

    def put(self, items: DataFrame, nodes: DataFrame | None = None, records: DataFrame | None = None) -> None:
        """Replaces items with their nodes and search records, all given."""
        none = lambda name: self.spark.createDataFrame([], STORE[name])
        self._put_items(self._at(), items, none("nodes") if nodes is None else nodes, none("records") if records is None else records)

    def _put_items(self, at: dict, items: DataFrame, nodes: DataFrame, records: DataFrame) -> None:
        """Writes the three tables' rows, passes them through the gates as they were written, and publishes them with the keys they replace."""
        folder = self.tables.folder(at)
        added = self._write(at, folder, {"items": items, "nodes": nodes, "records": records})
        new = {n: self._layer(n, path) for n, path in added.items()}
        rules = [integrity.item_violations(*new.values()), *self._repeated(new)]
        integrity.require_none(reduce(DataFrame.unionByName, rules))
        keys = self.tables.write(new["items"].select("item_id"), "item_id", f"{folder}/keys")
        after = self.tables.changed(at, added, dict.fromkeys(ITEM, keys))
        self.tables.publish(self._dimension(at, after, "records", new["records"]))

    def put_artifacts(
        self, artifacts: DataFrame, members: DataFrame, lineage: DataFrame, projections: DataFrame | None = None, sources: DataFrame | None = None, assets: DataFrame | None = None
    ) -> None:
        """Adds sources and assets that are missing; replaces artifacts with all that belongs to them.

        Without ``projections`` summaries and chunks are projected and embedded.
        A source without ``payload_json`` gets one of its columns and the facts of its
        assets; hashes and counts that are missing are computed. Refused are
        repeated keys, members or assets whose hash, size or number differ,
        sources whose payload does not list their assets, summaries whose stored
        inputs are not those they name, inputs and sources that nobody knows,
        and projections that are not those of the artifacts.
        """
        at, t = self._at(), self.tables
        folder = t.folder(at)
        new = {"artifacts": self._checked("artifacts", artifacts), "members": self._checked("members", members), "lineage": self._checked("lineage", lineage)}
        new["members"] = new["members"].withColumn("content_hash", F.coalesce("content_hash", F.sha2("payload_json", 256)))
        each = new["members"].groupBy("artifact_id").agg(F.count("*").cast("int").alias("_n"), _members_digest().alias("_h"))
        whole = new["artifacts"].join(each, "artifact_id", "left")
        of = _artifact_hash(F.col("payload_json"), F.col("_h"))
        new["artifacts"] = whole.withColumn("canonical_hash", F.coalesce("canonical_hash", of)).withColumn("member_count", F.coalesce("member_count", "_n", F.lit(0))).drop("_n", "_h")
        stored = t.table("projections", at, t.touched(artifacts, "artifact_id"))
        new["projections"] = self._checked("projections", self._embedded(projection.paper_targets(new["artifacts"], new["members"]), stored) if projections is None else projections)
        if sources is not None:
            none = self.spark.createDataFrame([], STORE["assets"])
            held = self._checked("assets", assets) if assets is not None else none
            have = t.table("sources", at, t.touched(sources, "source_revision_id")).select("source_revision_id")
            fresh = with_payload(self._checked("sources", sources), held).join(have, "source_revision_id", "left_anti")
            new["sources"], new["assets"] = fresh, held.join(fresh.select("source_revision_id").distinct(), "source_revision_id", "left_semi")
        elif assets is not None:
            raise ValueError("assets come with their sources")
        added = self._write(at, folder, new)
        rows = {n: self._layer(n, path) for n, path in added.items()}
        keys = t.write(rows["artifacts"].select("artifact_id"), "artifact_id", f"{folder}/keys")
        after = t.changed(at, added, dict.fromkeys(ARTIFACT, keys))
        integrity.require_none(self._artifact_rules(after, rows))
        t.publish(self._dimension(at, after, "projections", rows["projections"]))

    def _artifact_rules(self, after: dict, rows: dict[str, DataFrame]) -> DataFrame:
        """What new rows of artifacts, sources and assets break, beside what is stored."""
        t = self.tables
        named = rows["artifacts"].select("source_revision_id").where("source_revision_id is not null")
        known = t.table("sources", after, t.touched(named, "source_revision_id")).select("source_revision_id")
        inputs = t.table("artifacts", after, t.touched(rows["lineage"], "input_artifact_id")).select("artifact_id")
        a, m, p = rows["artifacts"], rows["members"], rows["projections"]
        rules = [
            integrity.artifact_violations(known, a, m, p, rows["lineage"].limit(0)),
            integrity.lineage_violations(a, rows["lineage"], inputs),
            integrity.projection_violations(projection.paper_targets(a, m), p),
            wrong_hashes(a, m),
            *self._repeated(rows),
        ]
        if "sources" in rows:
            rules.append(integrity.source_violations(rows["sources"], rows["assets"]))
        rules += [orphans.select(F.lit(f"{n} without artifact").alias("rule"), F.col("artifact_id").alias("key"), F.lit(None).cast("string").alias("detail")) for n in ("members", "lineage") for orphans in [integrity.orphans(rows[n], a, ["artifact_id"])]]
        return reduce(DataFrame.unionByName, rules)

    def put_structure(self, tree_id: str, source_revision_id: str, nodes: DataFrame, as_of=None) -> None:
        """Stores one structure tree by itself: its nodes as members, with the hash of all of them. No source is needed.

        nodes: node_id, parent_id, position, title, summary, content, children_ids, pages. A tree that breaks a rule is refused.
        """
        from .trees import violations

        tree = nodes.select(F.lit(tree_id).alias("tree_id"), "node_id", "parent_id", "position", "children_ids", "pages")
        if first := violations(tree).limit(1).collect():
            raise ValueError(f"{first[0]['rule']}: {first[0]['node_id']}")
        members = nodes.select(F.lit(tree_id).alias("artifact_id"), F.col("node_id").alias("member_id"), "parent_id", "position", F.to_json(F.struct("title", "summary", "content", "children_ids", "pages")).alias("payload_json"))
        about = F.to_json(F.struct(F.lit(tree_id).alias("tree_id"), F.lit(as_of).cast("string").alias("as_of")))
        art = self.spark.range(1).select(F.lit(tree_id).alias("artifact_id"), F.lit(source_revision_id).alias("source_revision_id"), F.lit(TREE).alias("artifact_kind"), F.lit("1").alias("schema_version"), about.alias("payload_json"), F.lit(0).alias("target_count"))
        self.put_artifacts(art, members, *[self.spark.createDataFrame([], STORE[n]) for n in ("lineage", "projections")])

    def artifact(self, artifact_id: str) -> DataFrame:
        """Members of one artifact in order, verified against its count, its hash and their hashes, its inputs as it names them, and, of a chunk set, its source; KeyError if there is none."""
        at = self._at()
        one = {n: self.tables.look_up(n, at, artifact_id) for n in ("artifacts", "members", "lineage")}
        row = one["artifacts"].limit(1).collect()
        if not row:
            raise KeyError(artifact_id)
        inputs = one["lineage"].select(F.col("input_artifact_id").alias("artifact_id"))  # their presence is the store's affair, not the artifact's
        rules = integrity.lineage_violations(one["artifacts"], one["lineage"], inputs).unionByName(wrong_hashes(one["artifacts"], one["members"]))
        got = one["members"].agg(F.count("*").alias("n"), F.count_if(F.sha2("payload_json", 256) != F.col("content_hash")).alias("wrong")).first()
        if got["n"] != (row[0]["member_count"] or 0) or got["wrong"]:
            raise integrity.StaleStoreError(f"corrupt artifact {artifact_id}")
        integrity.require_none(rules)
        if row[0]["artifact_kind"] == "paper_chunk_set":
            self.source(row[0]["source_revision_id"])
        return in_order(one["members"])

    def source(self, source_revision_id: str) -> tuple[DataFrame, DataFrame]:
        """One source and its assets, verified against its payload; KeyError if there is none."""
        at = self._at()
        row, assets = (self.tables.look_up(n, at, source_revision_id) for n in ("sources", "assets"))
        if not row.limit(1).count():
            raise KeyError(source_revision_id)
        integrity.require_none(integrity.source_violations(row, assets))
        return row, assets

    def open_structure(self, tree_id: str) -> DataFrame:
        """Nodes of a stored structure tree: tree_id, node_id, parent_id, position, title, summary, content, children_ids, pages."""
        members = self.artifact(tree_id)
        if not self.table("artifacts").where((F.col("artifact_id") == tree_id) & (F.col("artifact_kind") == TREE)).limit(1).count():
            raise KeyError(f"{tree_id} is not a structure tree")
        p = F.from_json("payload_json", "struct<title:string,summary:string,content:string,children_ids:array<string>,pages:array<int>>")
        return members.select(F.col("artifact_id").alias("tree_id"), F.col("member_id").alias("node_id"), "parent_id", "position", p.alias("p")).select("tree_id", "node_id", "parent_id", "position", "p.*")

    def delete(self, item_id: str) -> None:
        """Removes one item with its nodes and records; KeyError if there is none, and an error if only what belonged to it is left. One key is written."""
        at = self._at()
        if self.tables.look_up("items", at, item_id).limit(1).count() == 0:
            left = sum(self.tables.look_up(n, at, item_id).count() for n in ("nodes", "records"))
            if left:
                raise integrity.StaleStoreError(f"{left} nodes or records without item {item_id}")
            raise KeyError(item_id)
        keys = self.tables.write(self.spark.createDataFrame([(item_id,)], "item_id string"), "item_id", f"{self.tables.folder(at)}/keys")
        self.tables.publish(self.tables.changed(at, {}, dict.fromkeys(ITEM, keys)))

    def get(self, item_id: str) -> dict:
        """The item, verified against its hash, its node count and the hashes of its nodes."""
        at = self._at()
        row = self.tables.look_up("items", at, item_id).withColumn("_hash", F.sha2("payload_json", 256)).limit(2).collect()
        if not row:
            raise KeyError(item_id)
        nodes = self.tables.look_up("nodes", at, item_id)
        got = nodes.agg(F.count("*").alias("n"), F.count_if(F.sha2("payload_json", 256) != F.col("content_hash")).alias("wrong")).first()
        if row[0]["_hash"] != row[0]["canonical_hash"] or got["n"] != (row[0]["node_count"] or 0) or got["wrong"]:
            raise integrity.StaleStoreError(f"corrupt item {item_id}")
        return json.loads(row[0]["payload_json"])

    def nodes(self, item_id: str) -> DataFrame:
        """The nodes of one item, in order."""
        return in_order(self.tables.look_up("nodes", self._at(), item_id), "node_id")

    def resolve(self, locators: DataFrame) -> DataFrame:
        """Locators (source_revision_id, artifact_kind, artifact_id, member_id) with the payload they name; KeyError if one names nothing.

        A locator without a source names an item by its type, or one of its nodes.
        """
        owners = self.table("artifacts").select("artifact_id", "artifact_kind", "source_revision_id", "payload_json")
        owners = owners.unionByName(self.table("items").select(F.col("item_id").alias("artifact_id"), F.col("item_type").alias("artifact_kind"), F.lit(None).cast("string").alias("source_revision_id"), "payload_json"))
        parts = self.table("members").select("artifact_id", "member_id", F.col("payload_json").alias("member_payload"))
        parts = parts.unionByName(self.table("nodes").select(F.col("item_id").alias("artifact_id"), F.col("node_id").alias("member_id"), F.col("payload_json").alias("member_payload")))
        a, b = locators.alias("a"), owners.alias("b")
        same = (F.col("a.artifact_id") == F.col("b.artifact_id")) & (F.col("a.artifact_kind") == F.col("b.artifact_kind")) & F.col("a.source_revision_id").eqNullSafe(F.col("b.source_revision_id"))
        found = a.join(b, same, "left").select("a.*", "b.payload_json").join(parts, ["artifact_id", "member_id"], "left")
        missing = found.where("payload_json is null or (member_id is not null and member_payload is null)").limit(1).collect()
        if missing:
            raise KeyError(str(missing[0].asDict()))
        return found.select(*locators.columns, F.coalesce("member_payload", "payload_json").alias("payload_json"))

    def paper(self, source_revision_id: str) -> DataFrame:
        """The one chunk set and one summary of a source; ValueError unless there is exactly one of each."""
        rows = self.table("artifacts").where(F.col("source_revision_id") == source_revision_id)
        counts = {r["artifact_kind"]: r["n"] for r in rows.groupBy("artifact_kind").agg(F.count("*").alias("n")).collect()}
        if not counts:
            raise KeyError(source_revision_id)
        if any(counts.get(k) != 1 for k in ("paper_chunk_set", "paper_summary")):
            raise ValueError(f"ambiguous artifacts: {counts}")
        return rows.where(F.col("artifact_kind").isin("paper_chunk_set", "paper_summary"))

    def check(self) -> None:
        """Fails closed if any table disagrees with another. Versions that came about through gates alone are whole; another one that has passed is not checked again."""
        at = self._at()
        mark = f"CHECKED-{at['version']:012d}"
        if at["checked"] or mark in self.tables.names():
            return
        t = {n: self.tables.table(n, at) for n in STORE}
        rules = [
            integrity.item_violations(t["items"], t["nodes"], t["records"]),
            integrity.artifact_violations(t["sources"], t["artifacts"], t["members"], t["projections"], t["lineage"], t["assets"]),
            wrong_hashes(t["artifacts"], t["members"]),
            *self._repeated(t),
        ]
        integrity.require_none(reduce(DataFrame.unionByName, rules))
        try:
            self.tables.create_file(mark, "")
        except Exception:  # another reader has marked the same version meanwhile
            if mark not in self.tables.names():
                raise

    def compact(self, more_than: int = 8) -> None:
        """One layer in place of those of each table that has more than so many. Rows stay the same."""
        at = self._at()
        self.tables.publish(self.tables.compact(at, more_than))

    def verify(self) -> None:
        """Reads every layer and fails closed if its rows are not those that were written."""
        if bad := self.tables.damaged(self._at()):
            raise integrity.StaleStoreError(f"damaged files: {bad}")

    def index(self) -> DataFrame:
        """All that can be searched: records of items, and projections of papers with the times and kind of their source."""
        at = self._at()
        table = lambda name: self.tables.table(name, at)
        items = table("records").withColumn("artifact_kind", F.col("item_type")).withColumn("source_revision_id", F.lit(None).cast("string"))
        arts = table("artifacts").select("artifact_id", "artifact_kind")
        src = table("sources").select("source_revision_id", "as_of", "available_at", F.col("kind").alias("source_kind"))
        papers = table("projections").join(arts, "artifact_id").join(src, "source_revision_id")
        papers = papers.withColumnRenamed("artifact_id", "item_id").withColumnRenamed("member_id", "node_id").withColumn("item_type", F.col("artifact_kind"))
        return items.unionByName(papers, allowMissingColumns=True)

    def search(self, query: SemanticQuery, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
        """Evidence for a query: filter, rank, then the canonical rows of the few that are left. The text is embedded only if something is left to rank."""
        self.check()
        index = self.index()
        candidates = matching(index, query)
        if candidates.limit(1).count() == 0:
            top = candidates.withColumn("score", F.lit(0.0))
        else:
            best = rank(candidates, (embed or self.provider)(query.text), query.top_k)
            top = index.join(F.broadcast(best), "target_id")  # top_k rows
        t = self.table
        return projection.hits(top, t("items"), t("nodes"), t("artifacts"), t("members"))

    def close(self) -> None:
        self.closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def in_order(members: DataFrame, member: str = "member_id") -> DataFrame:
    """Members by parent (those without first), position and id."""
    return members.orderBy(F.coalesce("parent_id", F.lit("")), "position", member)


def _members_digest():
    """An order-free digest of an artifact's members: their number and the sums of two hashes of each."""
    row = F.to_json(F.struct("member_id", "parent_id", "position", "content_hash"))
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64(row), F.xxhash64(F.reverse(row)))]
    return F.concat_ws(":", F.count("*").cast("string"), *sums)


def _artifact_hash(payload, members):
    """Of an artifact's payload and its members' digest (null: none)."""
    return F.sha2(F.concat_ws("|", payload, F.coalesce(members, F.lit("0"))), 256)


def wrong_hashes(artifacts: DataFrame, members: DataFrame) -> DataFrame:
    """Artifacts whose canonical hash is not that of their payload and members."""
    each = members.groupBy("artifact_id").agg(_members_digest().alias("_h"))
    wrong = artifacts.join(each, "artifact_id", "left").where(_artifact_hash(F.col("payload_json"), F.col("_h")) != F.col("canonical_hash"))
    return wrong.select(F.lit("artifact hash").alias("rule"), F.col("artifact_id").alias("key"), F.col("canonical_hash").alias("detail"))


def with_payload(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Sources with their canonical payload, its hash and the number of their assets, where these are missing: a payload is the source's columns and the facts of each asset, by id."""
    facts = F.struct(*[F.col(c) for c in integrity.ASSET])
    each = assets.groupBy("source_revision_id").agg(F.array_sort(F.collect_list(facts)).alias("assets"))  # of one document, without their bytes
    own = [c for c in sources.columns if c not in ("payload_json", "canonical_hash", "asset_count")]
    rows = sources.join(each, "source_revision_id", "left")
    none = F.array().cast(each.schema["assets"].dataType)
    payload = F.coalesce("payload_json", F.to_json(F.struct(*own, F.coalesce("assets", none).alias("assets"))))
    rows = rows.withColumn("payload_json", payload).withColumn("asset_count", F.coalesce("asset_count", F.greatest(F.size("assets"), F.lit(0)), F.lit(0)))
    return rows.withColumn("canonical_hash", F.coalesce("canonical_hash", F.sha2("payload_json", 256))).select(*sources.columns)
