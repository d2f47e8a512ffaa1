"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, conversation_repair, neardup, ngram_join, packing, pieces, pii, quality, secret_scan, sharding, sql, toxicity, vector_codes
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(spark, table(spark, sf_dir, "documents")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(spark, table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).withColumn("grade", F.col("quality"))
    out = quality.score(docs, quality.train(spark, docs, labels))
    return out.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.digests(conversation_repair.repair(spark, conversation_repair.damaged(rows))).withColumnRenamed("conv_id", "_conv")
    ids = rows.select("conv_id").distinct()
    both = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return both.select("conv_id", *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "_conv"])


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(spark, table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict:
    own = [op1_chat_format, op2_packing, op3_pii, op4_near_duplicates, op5_ngram_join, op6_pieces, op7_toxicity, op8_nearest, op9_sharding, op10_quality]
    own += [op11_conversation_repair, op12_secret_scan, op13_vector_codes]
    return {f.__name__: f for f in own}


_TURNS = """(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')"""
_CONTROLS = r"len(regexp_extract_all({0}, '[<\[]\\*(/?s>|/?INST\])'))"

CHAT = f"""
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(20 + length(role) + length(text) + {_CONTROLS.format("role")} + {_CONTROLS.format("text")})::BIGINT AS formatted_chars
FROM {_TURNS} GROUP BY conv_id"""

_REACH = """reach AS (SELECT {id} AS node, {id} AS r FROM {t} UNION SELECT l.y, reach.r FROM reach JOIN l ON l.x = reach.node)"""

NEAR = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
{_REACH.format(id="vec_id", t="embeddings")}
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT node AS vec_id, min(r) AS component_id FROM reach GROUP BY node)"""

NGRAMS = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS ni, b.n AS nj, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT i, j FROM p WHERE 100 * c >= 85 * (ni + nj - c)), l AS (SELECT i AS x, j AS y FROM k UNION ALL SELECT j, i FROM k),
{_REACH.format(id="doc_id", t="documents")}
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT node AS doc_id, min(r) AS component_id FROM reach GROUP BY node) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL by brute force, for the operators whose rows SQL can give."""
    brute = {"op1_chat_format": CHAT, "op4_near_duplicates": NEAR, "op5_ngram_join": NGRAMS}
    return brute | {"op11_conversation_repair": sql.REPAIR, "op12_secret_scan": sql.SECRETS, "op13_vector_codes": sql.CODES}
