"""BM25 over documents or chunks."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bm25(docs: DataFrame, query: str, top_k: int = 5, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of the top_k documents for a query, best first, ties by key.

    Two scans, neither of which makes a list of words: the first reduces a
    document to its length and to whether it has each term, for the corpus
    figures (count, mean length, document frequencies: one row); the second
    only counts in documents that contain a term as a string.
    """
    terms = sorted(set(re.findall(TOKEN, query.lower())))
    if not query.strip() or top_k < 1:
        raise ValueError("a query needs text and top_k must be at least 1")
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = docs.select(key, F.lower(F.col(text)).alias("t"))
    tf = [F.when(F.col("t").contains(t), F.regexp_count("t", F.lit(rf"(?<![a-z0-9]){t}(?![a-z0-9])"))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)]
    length = F.coalesce(F.regexp_count("t", F.lit(TOKEN)), F.lit(0)).alias("dl")
    counted = low.select(key, length, *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    counted = low.where(reduce(or_, [F.col("t").contains(t) for t in terms])).select(key, length, *tf)
    hits = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row

    def weight(i: int) -> Column:
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(f > 0, idf * f / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    score = sum((weight(i) for i in range(1, len(terms))), weight(0))
    return hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(top_k)
