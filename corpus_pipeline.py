"""From raw documents to packed sequences, in five stages.

Each stage works on all that the one before kept, returns the columns of
``documents`` (the last: the packed pieces) and is written before the next one
reads it. Rows with a null id pass every stage. Texts are read whole, however
long. An empty table gives no rows; other columns than those of ``documents`` are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import ngram_join, packing, pii, quality, toxicity
from meridia.llm.common import Workspace, table
from meridia.llm.queries import held_out, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose grade is more likely than not above the lowest; an even chance keeps. Null and empty texts are graded by what they lack; repeated rows each."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).withColumnRenamed("quality", "grade")
    model = quality.train(spark, docs.select("doc_id", "text"), labels)
    return quality.score(docs, model, keep=COLUMNS).where("selected").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score one half or more. Null, empty and wordless texts score as texts without evidence; repeated rows are scored each."""
    model = toxicity.train(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles at a similarity of 0.8. Texts without words link with nothing and stay; of a repeated id the row that sorts first stays."""
    return ngram_join.keep_first(spark, docs.select(*COLUMNS), n=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, credentials and the terms that disclose them. Null texts stay null; repeated rows are handled each."""
    return pii.sanitise(spark, docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids in packed sequences. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: The classifiers, the tokenizer and the plan have no SQL form; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
