"""Model seams with their offline stand-ins."""

import pytest
from pyspark.sql import functions as F

from meridia.operators import providers, trees
from meridia.operators.integrity import StaleStoreError


def test_embedding(spark):
    assert providers.hashed_embedding("") != [0.0] * 64 and providers.hashed_embedding("a b") == providers.hashed_embedding("B a")
    now = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h3")], "id int, text string, hash string")
    old = spark.createDataFrame([(1, "h1", [9.0]), (2, "zz", [9.0])], "id int, hash string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in providers.embed_stale(now, old, "id", ["hash"], "text").collect()}
    assert got[1] == [9.0] and len(got[2]) == len(got[3]) == 64


def test_drafts():
    texts = {1: "one", 2: "two", 3: " "}
    nodes = providers.build_tree(providers.outline_draft([(1, "A", 1), (2, "x", 2), (2, "B", 1)], 3), texts, "T")
    assert [(n["path"], n["pages"], n["content"]) for n in nodes] == [("0", [1, 2, 3], None), ("0.0", [1], "one"), ("0.1", [2, 3], "two\n\n ")]
    with pytest.raises(ValueError, match="not in the source"):
        providers.build_tree([{"title": "x", "summary": "", "start_page": 1, "end_page": 9}], texts, "T")
    deep = [{"title": "x", "summary": "", "start_page": 1, "end_page": 1, "children": [{"title": "y", "summary": "", "start_page": 1, "end_page": 1}]}]
    assert len(providers.build_tree(deep, texts, "T", max_depth=3)) == 3  # the root is the first level
    with pytest.raises(ValueError, match="levels"):
        providers.build_tree(deep, texts, "T", max_depth=2)
    with pytest.raises(ValueError):
        providers.build_tree(providers.flat_draft(3, 10), texts, "T", max_nodes=2)
    assert [(d["start_page"], d["end_page"]) for d in providers.flat_draft(10, 4)] == [(1, 4), (5, 8), (9, 10)] and providers.flat_draft(5, 1) == []


def test_trees_are_valid(spark):
    rows = [("d", "T", {1: "one", 2: "two"}, [(1, "A", 1), (2, "B", 1)]), ("e", "T", {1: " "}, [(7, "A", 1)])]
    docs = spark.createDataFrame(rows, "doc_id string, title string, page_texts map<int,string>, headings array<struct<page:int,title:string,level:int>>")
    got = providers.build_trees(docs)
    assert got.where("error is not null").select("doc_id").collect()[0][0] == "e"
    nodes = got.where("error is null").withColumnRenamed("doc_id", "tree_id")
    assert nodes.count() == 3 and trees.violations(nodes).count() == 0


def test_summary_and_retrieval(spark):
    rows = [("d", i, f"c{i}", [i, i + 1], f"Text {i}. More of it.") for i in range(150)] + [("e", 0, "e0", [1], "Alone")]
    chunks = spark.createDataFrame(rows, "doc_id string, position int, chunk_id string, pages array<int>, text string")
    got = {r["doc_id"]: r for r in providers.summarise(chunks, group=4, fan_in=3, budget=500).collect()}
    assert len(got["d"]["findings"]) == 150 and [f["chunk_id"] for f in got["d"]["findings"]] == [f"c{i}" for i in range(150)]
    assert got["d"]["summary"].startswith("Text 0. Text 1.") and "Text 1" in got["d"]["summary"].splitlines()[-1] and len(got["d"]["summary"]) <= 500
    assert got["e"]["summary"] == "Alone" and got["e"]["findings"][0]["page"] == 1
    widths = []
    one = providers.summarise(chunks.where("doc_id = 'e'"), reduce=lambda t, b: widths.append(1)).first()
    assert one["summary"] == "Alone" and not widths  # one report needs no reduction
    for wrong, rule in (({"chunk_index": 99}, "outside its group"), ({"page": 999}, "outside its chunk"), ({"quote": "never said"}, "not in its chunk")):
        lying = lambda cs, w=wrong: {"summary": "x", "findings": [providers.first_sentences(cs)["findings"][0] | w]}
        with pytest.raises(StaleStoreError, match=rule):
            providers.summarise(chunks, research=lying)


def test_join_reports():
    assert providers.join_reports(["a" * 10, "b" * 100, ""], 51) == "a" * 10 + "\n" + "b" * 39
    assert providers.join_reports(["ab"], 5) == "ab"


def test_retrieval(spark):
    nodes = spark.createDataFrame([("t", 0, "Costs", "money"), ("t", 1, "Methods", "how it was done")], "tree_id string, n int, title string, summary string")
    assert [r["title"] for r in providers.retrieve(nodes, "which methods were used").collect()] == ["Methods"]
    assert providers.retrieve(nodes, "zzz").count() == 0
    assert [(r["n"], r["nth"]) for r in providers.retrieve(nodes, "q", lambda s, q, h: [1, 1, 0]).orderBy("nth").collect()] == [(1, 0), (0, 1)]
    seeds = spark.createDataFrame([("t", 1)], "tree_id string, n int")
    assert providers.retrieve(nodes, "q", lambda s, q, h: h, seeds=seeds).first()["title"] == "Methods"
    assert providers.lexical_selector('[{"n":0,"title":"a"},{"n":1,"title":"a"}]', "a", [1], 1) == [1]
    for call in (lambda: providers.retrieve(nodes, " \n"), lambda: providers.retrieve(nodes, "q", lambda s, q, h: [7]), lambda: providers.retrieve(nodes, "q", seeds=seeds.withColumn("n", F.lit(9)))):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(providers.RetrievalError):
        providers.retrieve(nodes, "q", lambda s, q, h: [0, 1], max_evidence=1)


def test_structured_answers():
    calls = []

    def run(plain):
        calls.append(plain)
        if not plain:
            raise ValueError("no json schema here")
        return '```json\n{"a": 1}\n```'

    assert providers.run_structured(run, lambda v: v["a"], lambda e: "schema" in str(e)) == 1 and calls == [False, True]
    with pytest.raises(ValueError):
        providers.run_structured(run, lambda v: v, lambda e: False)
    assert providers.run_structured(lambda plain: {"a": 2}, lambda v: v["a"], lambda e: True) == 2
