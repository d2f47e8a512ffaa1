"""The store: versions, projection, vectors, evidence."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from meridia.operators import integrity, trees
from meridia.operators.layers import ConflictError
from meridia.operators.library import KnowledgeLibrary
from meridia.operators.search import SemanticQuery
from meridia.plans.schemas import STORE


def items(spark, *rows):
    body = [(i, "flat", kind, "flat", "1.0", json.dumps(p)) for i, kind, p in rows]
    return spark.createDataFrame(body, "item_id string, knowledge_class string, item_type string, item_shape string, schema_version string, payload_json string")


def test_a_lost_manifest_is_not_an_empty_store(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    lib = KnowledgeLibrary.open(spark, root)
    lib.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"})))
    os.makedirs(tmp_path / "lib" / "v9-crash" / "items")  # tables of a commit that was never published
    assert KnowledgeLibrary.open(spark, root).get("a") == {"claim": "x"}
    with pytest.raises(Exception, match="exist"):
        lib.tables.create_file(f"MANIFEST-{lib.version:012d}.json", "{}")  # a second writer of the same version
    (tmp_path / "lib" / "MANIFEST-000000000099.json").write_text("")  # cut off while it was written
    assert KnowledgeLibrary.open(spark, root).get("a") == {"claim": "x"}
    for f in (tmp_path / "lib").glob("MANIFEST-*"):
        f.unlink()
    with pytest.raises(integrity.StaleStoreError, match="no manifest"):
        KnowledgeLibrary.open(spark, root)


def test_migration(spark, tmp_path):
    """Stores of older versions have one folder for each table and no buckets."""
    root = f"file://{tmp_path}/lib"
    body = items(spark, ("a", "thesis", {"claim": "x"})).withColumn("canonical_hash", F.sha2("payload_json", 256)).withColumn("node_count", F.lit(0)).withColumn("target_count", F.lit(0))
    for version in (1, 2):
        path = f"file://{tmp_path}/old{version}/v1-aa/items"
        body.write.parquet(path)
        text = json.dumps({"schema_version": version, "version": 4, "tables": {"items": path}})
        (tmp_path / f"old{version}" / ("CURRENT.json" if version == 1 else "MANIFEST-000000000004.json")).write_text(text)
        new = KnowledgeLibrary.open(spark, f"file://{tmp_path}/old{version}")
        assert new.get("a") == {"claim": "x"} and new.version == 5
        new.put_knowledge(items(spark, ("a", "thesis", {"claim": "y"}), ("b", "thesis", {"claim": "z"})))
        assert new.get("a") == {"claim": "y"} and new.table("items").count() == 2
        new.check()  # the first version was never checked, so all of it is read
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "CURRENT.json").write_text(json.dumps({"schema_version": 7, "version": 1, "tables": {}}))
    with pytest.raises(RuntimeError, match="not supported"):
        KnowledgeLibrary.open(spark, root)


def test_only_what_changed_is_embedded(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    vectors = lambda lib: {r["target_id"]: r["embedding"] for r in lib.table("records").collect()}
    KnowledgeLibrary.open(spark, root, provider=lambda t: [1.0, 0.0], model="m", dimension=2).put_knowledge(items(spark, ("a", "thesis", {"claim": "x"}), ("b", "thesis", {"claim": "y"})))
    lib = KnowledgeLibrary.open(spark, root, provider=lambda t: [0.0, 1.0], model="m", dimension=2)
    lib.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"}), ("b", "thesis", {"claim": "z"})))
    assert vectors(lib) == {"item:a": [1.0, 0.0], "item:b": [0.0, 1.0]}
    other = KnowledgeLibrary.open(spark, root, provider=lambda t: [2.0, 2.0], model="n", dimension=2)
    other.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"})))
    assert vectors(other)["item:a"] == [2.0, 2.0]
    with pytest.raises(Exception, match="must not be empty"):
        lib.put_knowledge(items(spark, ("c", "thesis", {"claim": ""})))
    assert set(vectors(lib)) == {"item:a", "item:b"}  # a failed put changes nothing


def test_trees_as_items(spark, tmp_path):
    tree = items(spark, ("t", "talk", {})).withColumn("item_shape", F.lit("tree"))
    rows = [("t", "r", None, 0, "Root", [(9, "q")]), ("t", "a", "r", 0, "First", [(1, "qa")]), ("t", "b", "r", 1, "Second", [])]
    nodes = spark.createDataFrame([(i, n, p, k, json.dumps({"title": x, "summary": "s", "citations": [{"source_id": "src", "page": g, "quote": q} for g, q in c]})) for i, n, p, k, x, c in rows], "item_id string, node_id string, parent_id string, position int, payload_json string")
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib", provider=lambda t: [float(len(t)), 1.0], model="m", dimension=2)
    lib.put_knowledge(tree, nodes)
    hits = {r["target_id"]: r for r in lib.search(SemanticQuery("x", tree_id="t")).collect()}
    assert set(hits) == {"item:t", "node:t:a", "node:t:b"}
    assert hits["node:t:a"]["matched_text"] == "First\ns" and hits["node:t:a"]["citations"][0]["quote"] == "qa" and hits["item:t"]["citations"][0]["page"] == 9
    assert hits["node:t:a"]["locator"]["member_id"] == "a" and hits["node:t:b"]["projection"]["model"] == "m" and hits["node:t:b"]["citations"] == []
    assert [r["node_id"] for r in lib.nodes("t").collect()] == ["r", "a", "b"]
    loc = spark.createDataFrame([(None, "talk", "t", "a"), (None, "talk", "t", None)], "source_revision_id string, artifact_kind string, artifact_id string, member_id string")
    assert lib.resolve(loc).count() == 2
    with pytest.raises(KeyError):
        lib.resolve(loc.withColumn("artifact_kind", F.lit("news")))


def test_structures_are_verified(spark, tmp_path):
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib")
    rows = [("r", None, 0, "R", "", None, ["a"], [1]), ("a", "r", 0, "A", "", "text", [], [1])]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, position int, title string, summary string, content string, children_ids array<string>, pages array<int>")
    lib.put_structure("t", "s", nodes)
    assert {r["node_id"]: r["content"] for r in lib.open_structure("t").collect()} == {"r": None, "a": "text"}
    with pytest.raises(KeyError):
        lib.open_structure("other")
    with pytest.raises(ValueError, match="known parent"):
        lib.put_structure("u", "s", nodes.withColumn("parent_id", F.when(F.col("node_id") == "a", "zz")))
    wrong = lib.table("members").withColumn("payload_json", F.lit("{}"))
    lib._overwrite("members", wrong)
    with pytest.raises(integrity.StaleStoreError):
        lib.open_structure("t")
    with pytest.raises(integrity.StaleStoreError):
        lib.check()


def test_a_checked_version_is_not_checked_again(spark, tmp_path, monkeypatch):
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib")
    lib.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"})))
    lib._overwrite("items", lib.table("items"))
    lib.check()
    monkeypatch.setattr(integrity, "require_none", lambda v: pytest.fail("checked twice"))
    lib.check()
    assert lib.search(SemanticQuery("x")).count() == 1


def test_what_a_put_writes_is_checked(spark, tmp_path, monkeypatch):
    """Repeated keys, lost records and vectors of another dimension are refused, and nothing changes."""
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib")
    lib.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"})))
    before = lib.version
    twice = items(spark, ("b", "thesis", {"claim": "x"}), ("b", "thesis", {"claim": "y"}))
    with pytest.raises(integrity.StaleStoreError, match="repeated key|target count|older item"):
        lib.put_knowledge(twice)
    one = items(spark, ("c", "thesis", {"claim": "x"})).withColumn("canonical_hash", F.sha2("payload_json", 256)).withColumn("target_count", F.lit(1)).withColumn("node_count", F.lit(0))
    with pytest.raises(integrity.StaleStoreError, match="target count"):
        lib.put(one)
    other = KnowledgeLibrary.open(spark, lib.root, provider=lambda t: [1.0], model="short", dimension=1)
    with pytest.raises(integrity.StaleStoreError, match="one dimension"):
        other.put_knowledge(items(spark, ("d", "thesis", {"claim": "x"})))
    assert lib.version == before and lib.table("items").count() == 1
    other.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"})))  # the only vector that there is may change its dimension
    lib.check()
    monkeypatch.setattr(integrity, "require_none", lambda v: pytest.fail("read again"))
    lib.check()  # gates have seen all of it


def test_of_two_writers_one_fails(spark, tmp_path):
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib")
    lib.put_knowledge(items(spark, ("a", "thesis", {"claim": "x"})))
    late, at = KnowledgeLibrary.open(spark, lib.root), lib._at()
    late._at = lambda: at  # has begun with this version
    lib.put_knowledge(items(spark, ("b", "thesis", {"claim": "y"})))
    for change in (lambda: late.put_knowledge(items(spark, ("c", "thesis", {"claim": "z"}))), lambda: late.delete("a"), lambda: late.compact(0)):
        with pytest.raises(ConflictError):
            change()
    assert sorted(r["item_id"] for r in lib.table("items").collect()) == ["a", "b"]


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_small_put_writes_little(spark, tmp_path):
    """One item into 100,000: under 1 % of the bytes, the same rows as a full rewrite, one bucket read."""
    root = tmp_path / "lib"
    lib = KnowledgeLibrary.open(spark, f"file://{root}", provider=lambda t: [float(len(t)), 1.0], model="m", dimension=2)
    body = F.to_json(F.struct(F.concat(F.lit("claim "), F.col("id")).alias("claim")))
    many = spark.range(100_000).select(F.col("id").cast("string").alias("item_id"), F.lit("flat").alias("knowledge_class"), F.lit("thesis").alias("item_type"), F.lit("flat").alias("item_shape"), F.lit("1.0").alias("schema_version"), body.alias("payload_json"))
    lib.put_knowledge(many)
    whole = size(root)
    lib.put_knowledge(items(spark, ("77", "thesis", {"claim": "new"})))
    lib.delete("99")
    assert size(root) - whole < whole / 100
    plain = lambda d: sorted(map(str, d.collect()))
    want = many.where("item_id not in ('77', '99')").select("item_id", "payload_json").unionByName(items(spark, ("77", "thesis", {"claim": "new"})).select("item_id", "payload_json"))
    assert plain(lib.table("items").select("item_id", "payload_json")) == plain(want)
    assert lib.get("77") == {"claim": "new"} and lib.table("records").count() == 99_999
    files = lib.tables.look_up("items", lib._at(), "77")._jdf.queryExecution().toString()
    assert "PartitionFilters" in files and "_bucket" in files
    before = {n: plain(lib.table(n)) for n in ("items", "records")}
    lib.compact(1)
    assert {n: plain(lib.table(n)) for n in before} == before and all(len(e["rows"]) == 1 and not e["gone"] for e in lib._at()["tables"].values())
    lib.verify()
    lib.tables.vacuum()
    assert {n: plain(lib.table(n)) for n in before} == before and len(lib.tables.numbers()) == 1 and size(root) < 1.2 * whole


def test_damaged_files_are_found(spark, tmp_path):
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib")
    lib.put_knowledge(items(spark, *[(str(i), "thesis", {"claim": str(i)}) for i in range(20)]))
    lib.verify()
    next((tmp_path / "lib").glob("v*/items/_bucket=*/*.parquet")).unlink()
    with pytest.raises(integrity.StaleStoreError, match="damaged files.*items"):
        lib.verify()


def paper(spark):
    """A source with an asset, a chunk set of two and a summary of it."""
    row = lambda name, **k: spark.createDataFrame([tuple(k.get(f.name) for f in STORE[name])], STORE[name])
    source = row("sources", source_revision_id="s", content_hash="h", kind="http")
    blob = bytearray(b"png")
    asset = row("assets", asset_id="p1", source_revision_id="s", kind="figure", page_number=1, media_type="image/png", content_hash=hashlib.sha256(blob).hexdigest(), size_bytes=3, blob=blob)
    chunks = row("artifacts", artifact_id="set", source_revision_id="s", artifact_kind="paper_chunk_set", payload_json="{}", target_count=2)
    summary = row("artifacts", artifact_id="sum", source_revision_id="s", artifact_kind="paper_summary", payload_json=json.dumps({"summary": "about", "derived_from": [{"artifact_id": "set"}]}), target_count=1)
    members = row("members", artifact_id="set", member_id="c1", position=0, payload_json='{"text":"one"}').unionByName(row("members", artifact_id="set", member_id="c2", position=1, payload_json='{"text":"two"}'))
    lineage = row("lineage", artifact_id="sum", input_artifact_id="set", relation="generated_from")
    return {"artifacts": chunks.unionByName(summary), "members": members, "lineage": lineage, "sources": source, "assets": asset}


def test_papers_are_whole_or_refused(spark, tmp_path):
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib", provider=lambda t: [float(len(t)), 1.0], model="m", dimension=2)
    p = paper(spark)
    wrong = {
        "lineage set": {"lineage": p["lineage"].limit(0)},
        "asset set": {"sources": p["sources"].withColumn("payload_json", F.lit('{"assets":[]}'))},
        "projection without source": {"sources": None, "assets": None},
        "members without artifact": {"artifacts": p["artifacts"].where("artifact_id = 'sum'")},
    }  # all the others: the query store_gates
    for rule, change in wrong.items():
        with pytest.raises(integrity.StaleStoreError) as said:
            lib.put_artifacts(**(p | change))
        assert rule in {r["rule"] for r in said.value.violations}
        assert lib.version == 1
    lib.put_artifacts(**p)
    lib.check()
    assert [r["member_id"] for r in lib.artifact("set").collect()] == ["c1", "c2"] and lib.artifact("sum").count() == 0
    row, assets = lib.source("s")
    assert row.first()["asset_count"] == 1 and assets.count() == 1
    lib.put_artifacts(**p)  # the same again: sources stay, artifacts are replaced
    assert lib.table("sources").count() == 1 and lib.table("projections").count() == 3
    for name, bad, call in (("assets", lib.table("assets").limit(0), lambda: lib.source("s")), ("lineage", lib.table("lineage").limit(0), lambda: lib.artifact("sum")), ("assets", None, None)):
        if call:
            lib._overwrite(name, bad)
            with pytest.raises(integrity.StaleStoreError):
                call()
    with pytest.raises(integrity.StaleStoreError):
        lib.artifact("set")  # its source has lost an asset
    with pytest.raises(KeyError):
        lib.source("other")


def test_node_content(spark):
    nodes = spark.createDataFrame([("t", "r", None, 0, "R", None), ("t", "a", "r", 0, "A", "one"), ("t", "b", "r", 1, "B", "two")], "tree_id string, node_id string, parent_id string, position int, title string, content string")
    texts = trees.leaf_text(trees.walk(spark, nodes), nodes)
    assert [(r["node_id"], r["content"]) for r in trees.node_content(nodes, texts, ["b", "r"]).collect()] == [("b", "two"), ("r", "one\n\ntwo")]
    with pytest.raises(ValueError, match="unknown"):
        trees.node_content(nodes, texts, ["zz"])
    with pytest.raises(ValueError, match="more than"):
        trees.node_content(nodes, texts, list("abcdef"))
