"""A stored inverted index for BM25.

Postings are rows of (term, block): a block is a fixed part of the documents, so that
the list of a frequent term is many rows, each with the largest count and the
smallest length in it, which bound every score in the block. They are
layers laid out by term (``layers.LayeredTables``), so a search reads the files of its
terms' buckets, and of these the row groups that hold the terms. Corpus counts are
kept in the manifest and grow with each ``add``.

A search reads the bounds first (not the postings), scores the most promising
blocks, and then those alone whose bound reaches the k-th score so far: its
results are those of a full scan.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import ddl
from . import integrity
from .layers import LayeredTables
from .ranking import TOKEN, tokens

#: more blocks than this meet the postings in a join
LISTED = 2000


def term_counts(w: Column) -> Column:
    """[(term, tf)] of a document's words, in the row itself: the runs of the sorted words."""
    starts = lambda s: F.filter(F.slice(F.sequence(F.lit(0), F.size(s)), 1, F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = lambda s, p: F.transform(p, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(p, j + 1), F.size(s)) - at).alias("tf")))
    # both arrays are elements of an outer array: a lambda's own variables are evaluated once
    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(w)), lambda s: F.transform(F.array(starts(s)), lambda p: runs(s, p)))))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, key_type: str = "bigint", block: int = 512, buckets: int = 64):
        self.spark, self.block = spark, block
        self.looked: list[int] = []  # how many blocks each look of the last search read
        schemas = {
            "postings": ddl(f"term string, block bigint, n int, max_tf int, min_dl int, docs array<struct<key:{key_type},tf:int,dl:int>>"),
            "documents": ddl(f"key {key_type}, dl int"),
        }
        self.tables = LayeredTables(spark, root, schemas, {"postings": "term", "documents": "key"}, buckets)

    @classmethod
    def open(cls, spark: SparkSession, root: str, key_type: str = "bigint", block: int = 512, buckets: int = 64) -> "TextIndex":
        """Opens an index, which keeps its own settings, or creates one."""
        index = cls(spark, root, key_type, block, buckets)
        if not index.tables.numbers():
            index.tables.publish({"next": 1, "tables": {}, "settings": [key_type, block, buckets], "documents": 0, "words": 0})
        return cls(spark, root, *index.tables.latest()["settings"])

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds documents; null texts are empty. Keys that are null, repeated or there already are refused. Another writer meanwhile: ConflictError."""
        t = self.tables
        at = t.latest()
        folder = t.folder(at)
        words = docs.select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).select("key", "w", F.size("w").alias("dl"))
        path = t.write(words.select("key", F.col("dl").cast("int").alias("dl")), "key", f"{folder}/documents")
        new = t.layer("documents", {"path": path})
        known = t.table("documents", at, t.touched(new, "key")).join(new.select("key"), "key", "left_semi").select(F.lit("known key").alias("rule"), F.col("key").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
        integrity.require_none(integrity.repeated_keys(new, ["key"], "documents").unionByName(known))
        n, total = new.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        each = words.select("key", "dl", F.explode(term_counts(F.col("w"))).alias("t")).select("t.term", "key", "dl", "t.tf")
        number = F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(n / self.block)))) + F.lit(at["next"] << 32)
        lists = each.groupBy("term", number.alias("block")).agg(
            F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").cast("int").alias("min_dl"),
            F.array_sort(F.collect_list(F.struct("key", "tf", F.col("dl").cast("int").alias("dl")))).alias("docs"),
        )
        after = t.changed(at, {"documents": path, "postings": t.write(lists, "term", f"{folder}/postings")})
        t.publish(after | {"documents": at["documents"] + n, "words": at["words"] + total})

    def postings(self, terms: list[str], at: dict | None = None) -> DataFrame:
        """The posting rows of some terms: the scan has their buckets and names."""
        named = self.spark.createDataFrame([(x,) for x in terms], "term string")
        return self.tables.table("postings", at or self.tables.latest(), self.tables.touched(named, "term")).where(F.col("term").isin(terms))

    def search(self, query: str, top_k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(key, score) of the top_k documents, best first, ties by key; as ``ranking.bm25``."""
        terms = sorted(set(re.findall(TOKEN, query.lower())))
        if not query.strip() or top_k < 1:
            raise ValueError("a query needs text and top_k must be at least 1")
        at = self.tables.latest()
        empty = self.tables.table("documents", at, []).select("key", F.lit(0.0).alias("score"))
        if not terms or not at["documents"]:
            return empty
        lists = self.postings(terms, at)
        counts = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each term of the query
        if not counts:
            return empty
        idf = F.create_map(*[F.lit(x) for term, df in counts.items() for x in (term, math.log(1 + (at["documents"] - df + 0.5) / (df + 0.5)))])
        mean = at["words"] / at["documents"]

        def weight(tf: Column, dl: Column) -> Column:
            return F.element_at(idf, F.col("term")) * tf / (tf + k1 * (1 - b + b * dl / F.lit(mean)))

        bounds = lists.groupBy("block").agg(F.sum(weight(F.col("max_tf"), F.col("min_dl"))).alias("bound"), F.sum("n").alias("n"))

        def scored(blocks: DataFrame, limit: int) -> DataFrame:
            """The best of some blocks; a short list of them goes into the scan."""
            names = [r["block"] for r in blocks.select("block").limit(LISTED + 1).collect()]
            self.looked.append(len(names))
            some = lists.where(F.col("block").isin(names)) if len(names) <= LISTED else lists.join(blocks.select("block"), "block", "left_semi")
            each = some.select("term", F.explode("docs").alias("d")).select("d.key", weight(F.col("d.tf"), F.col("d.dl")).alias("w"))
            return each.groupBy("key").agg(F.sum("w").alias("exact")).orderBy(F.round("exact", 6).desc(), "key").limit(limit)

        self.looked = []
        first = bounds.orderBy(F.desc("bound"), "block").limit(max(4, top_k))
        reached = scored(first, top_k).collect()  # top_k rows
        least = reached[-1]["exact"] - 1e-6 if len(reached) == top_k else -1.0
        best = scored(bounds.where(F.col("bound") >= least), top_k)
        return best.select("key", F.round("exact", 6).alias("score")).orderBy(F.desc("score"), "key")
