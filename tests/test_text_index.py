"""The stored index against the scan."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from meridia.operators import integrity, ranking
from meridia.operators.layers import LayeredTables
from meridia.operators.text_index import TextIndex, term_counts


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("query", ["w0 w3", "w40", "W55 w55 w2 nothing", "w0", "nowhere"])
def test_same_scores_as_a_scan(spark, index, query):
    """Documents that came in several parts, with few and with many blocks."""
    found, docs = index
    for k in (1, 7, 500):
        want = [tuple(r) for r in ranking.bm25(docs, query, k).collect()]
        assert [tuple(r) for r in found.search(query, k).collect()] == want


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([*corpus(400, 1), (900, None), (901, ""), (902, "w40 " * 30)], "doc_id long, text string")
    root = f"file://{tmp_path_factory.mktemp('i')}/index"
    found = TextIndex.open(spark, root, block=16, buckets=8)
    for part in range(3):
        TextIndex.open(spark, root).add(docs.where(F.col("doc_id") % 3 == part))
    return found, docs


def test_only_the_terms_are_read(spark, index, capsys):
    found, docs = index
    found.postings(["w40"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(term" in plan or "EqualTo(term,w40)" in plan
    assert "PartitionFilters" in plan and "_bucket" in plan
    words = docs.agg(F.sum(F.size(ranking.tokens(F.coalesce("text", F.lit("")))))).first()[0]
    assert found.tables.latest()["documents"] == 403 and found.tables.latest()["words"] == words


def test_blocks_without_hope_are_left_out(spark, index):
    """One document has far more of the term than any other: the second look needs its block alone."""
    found, _ = index
    assert found.postings(["w40"]).count() > 4
    assert found.search("w40", 1).first()["key"] == 902 and found.looked == [4, 1]


def test_keys_are_new(spark, index):
    found, docs = index
    for bad in (docs.where("doc_id = 3"), docs.limit(1).unionByName(docs.limit(1)).withColumn("doc_id", F.lit(5000).cast("long")), spark.createDataFrame([(None, "x")], "doc_id long, text string")):
        with pytest.raises(integrity.StaleStoreError):
            found.add(bad)
    with pytest.raises(ValueError):
        found.search(" ")


def test_words_are_counted_in_their_row(spark, capsys):
    """A document's counts need no shuffle; repeated, single and no words."""
    texts = [(0, ["b", "a", "b"]), (1, []), (2, ["x"]), (3, ["q"] * 500), (4, [f"w{i % 37}" for i in range(1000)])]
    df = spark.createDataFrame(texts, "key long, w array<string>").select("key", F.explode(term_counts(F.col("w"))).alias("t")).select("key", "t.*")
    got = {(r["key"], r["term"]): r["tf"] for r in df.collect()}
    assert got == {(k, term): n for k, w in texts for term, n in collections.Counter(w).items()} and df.count() == len(got)
    assert df.schema["tf"].dataType.simpleString() == "int"
    df.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_one_shuffle_by_term_and_block(spark, tmp_path, monkeypatch):
    """Postings are dealt out by term and block alone before they are written, not by term and document as well."""
    plans, write = {}, LayeredTables.write

    def seen(self, df, key, path):
        plans[key] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, key, path)

    monkeypatch.setattr(LayeredTables, "write", seen)
    TextIndex.open(spark, f"file://{tmp_path}/index").add(spark.createDataFrame(corpus(50, 2), "doc_id long, text string"))
    assert plans["term"].count("Exchange") == 1
