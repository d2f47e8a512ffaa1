"""Every registered query of the package runs over its whole table, and agrees with its SQL where it has one."""

import pytest
from pyspark.sql import functions as F

from meridia.llm import ann, common, neardup, packing, pieces, queries, sharding, toxicity
from tests.oracle import connection, same

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op2": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4": ["vec_id", "n_links", "component_id", "kept"],
    "op5": ["doc_id", "n_shingles", "component_id"],
    "op6": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["query_id", "rank", "vec_id", "score"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10": ["doc_id", "expected_grade", "tail_probability", "selected", "held_out"],
    "op11": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op13": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DIR)
    assert df.columns[: len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]
    if name in queries.oracle_sql():
        assert same(df, queries.oracle_sql()[name], connection(DIR)) is None
    elif "doc_id" in df.columns:
        docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id")
        assert df.select("doc_id").distinct().exceptAll(docs.distinct()).count() == 0 and df.select("doc_id").distinct().count() == docs.distinct().count()


def test_little_padding(spark):
    """All but a few sequences are full: padded tokens are under 2 % of all."""
    rows = queries.op2_packing(spark, DIR).collect()
    sizes = {r["sequence_id"]: r["padded_length"] for r in rows}
    assert sum(sizes.values()) < 1.02 * sum(r["length"] for r in rows) + 2048


def test_staged_tables_go_when_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_OPEN", [])
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    assert queries.op9_sharding(spark, DIR).count() and list(tmp_path.iterdir())
    common.clean(spark)
    assert not list(tmp_path.iterdir())


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(RuntimeError, match="shared|share"):
        common.shared_dir(Session())


ROWS = [(1, "some words here"), (1, "some words here"), (1, "other words"), (None, "nameless"), (None, None), (2, ""), (3, None), (4, "word " * 60_000)]


def test_ids_that_are_null_or_repeated(spark):
    """Every row stays a row, with null ids as they are, whatever other columns are called."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("size", "shard", "h", "length", "score", "ids", "term", "n"):
        df = df.withColumn(name, F.lit("x"))
    ids = sorted(str(i) for i, _ in ROWS)
    packed = packing.pack(spark, df, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["start"] == 0) == ids and sum(r["length"] for r in packed if r["doc_id"] == 4) == 60_001
    assert sorted(str(r["doc_id"]) for r in pieces.encode(df, queries.tokenizer_path("piece_bpe_32k.model")).collect()) == ids
    rows = sharding.shard(spark, df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ids and len({(r["shard"], r["slot"]) for r in rows}) == len(ROWS)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    assert sorted(str(r["doc_id"]) for r in toxicity.score(df, toxicity.train(spark, df, labels)).collect()) == ids


def test_vectors_with_repeated_ids(spark):
    """A repeated id is a vector each in links; as a query its smallest vector asks, in any order of rows."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (None, [1.0, 0.0], 0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("v", F.lit("x"))
        links = sorted((str(r["vec_id"]), r["n_links"]) for r in neardup.near_duplicates(spark, df).collect())
        assert links == [("1", 1), ("1", 2), ("2", 2), ("3", 1), ("None", 2)]
        found = sorted((r["rank"], r["vec_id"]) for r in ann.nearest(spark, df, F.col("vec_id") == 1, k=2).collect())
        assert found == [(1, 3), (2, 2)]
