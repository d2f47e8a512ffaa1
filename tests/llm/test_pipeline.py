"""The pipeline's stages, each against a plain version on its own input."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import plain_components, plain_shingles

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read as the stages are run in production."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{root}/{k}")
        kept = spark.read.parquet(f"{root}/{k}")
        out[name] = (docs, kept)
        docs = kept
    return out


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes


def test_filters_keep_rows_whole(spark, stages):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for name, wanted in (("quality classifier", lambda r: r["quality"] == 1), ("toxicity", lambda r: r["toxic"] == 0)):
        before, after = ({r["doc_id"]: r for r in df.collect()} for df in stages[name])
        assert all(before[i] == r for i, r in after.items())
        known = [i for i in before if i in labels]
        assert sum((i in after) == wanted(labels[i]) for i in known) >= 0.9 * len(known)


def test_one_of_each_group_stays(stages):
    before, after = (sorted((r["doc_id"], r["text"]) for r in df.collect()) for df in stages["n-gram Jaccard join"])
    roots = plain_components([plain_shingles(t, 5) for _, t in before], 80)
    assert [d for d, _ in after] == [d for (d, _), r, i in zip(before, roots, range(len(before))) if r == i]


def test_personal_data_is_gone(stages):
    before, after = stages["personal data"]
    pairs = before.select("doc_id", F.col("text").alias("old")).join(after, "doc_id")
    assert pairs.count() == before.count() == after.count()
    assert after.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
    assert after.where("n_chars <> length(text)").count() == 0


def test_packed_whole(stages):
    before, after = stages["packing"]
    tokens = collections.Counter()
    for r in after.collect():
        tokens[r["doc_id"]] += r["length"]
        assert 0 < r["length"] <= 2048
    assert set(tokens) == {r["doc_id"] for r in before.select("doc_id").collect()}
    whole = {r["doc_id"]: r["doc_tokens"] for r in after.collect()}
    assert dict(tokens) == whole


def test_run_and_empty_table(spark, stages):
    assert corpus_pipeline.run(spark, DIR).count() == stages["packing"][1].count()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
