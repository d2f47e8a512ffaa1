"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Labels (shards) start from a hash, so
they are even. In every round, groups count their bytes per shard and wish to
be where most of them are; wishes are summed per (from, to, hash slice), and
as many slices move as the receiving shard's quota allows. Groups larger than
a share of a shard are split beforehand into salted subgroups. What the moves
unbalanced is then evened out with documents that have no links, which cut no
edge (and, where those do not suffice, with whole groups): bytes per (shard,
hash slice) are summed and whole slices flow from full shards to empty ones. Every table that comes to the driver has a fixed
size: shards x shards x slices at most.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace


def _accept(wishes: list, load: list[float], limit: float) -> list[tuple[int, int, int]]:
    """The (from, to, slice) moves that keep every shard at or below the limit, in turn and net of what leaves."""
    taken = []
    for f, t, s, b in sorted(wishes, key=lambda w: (w[2], w[0], w[1])):
        if load[t] + b <= limit:
            load[t] += b
            load[f] -= b
            taken.append((f, t, s))
    return taken


def _even(slices: list, load: list[float]) -> list[tuple[int, int, int]]:
    """Moves of unlinked slices (shard, slice, bytes) that bring all shards towards the mean."""
    mean, moves, slices_end = sum(load) / len(load), [], float("inf")
    by_shard: dict[int, list] = {}
    for shard, s, b in slices:
        by_shard.setdefault(shard, []).append((b, s))
    for shard in by_shard:
        by_shard[shard].sort()
    while True:
        full = max((x for x in by_shard if by_shard[x]), key=lambda x: load[x], default=None)
        if full is None or load[full] <= mean:
            return moves
        low = min(range(len(load)), key=lambda x: load[x])
        most = max(min(load[full] - mean, mean - load[low]), (load[full] - load[low]) / 2)
        at = bisect_right(by_shard[full], (most, slices_end)) - 1
        if at < 0:
            by_shard[full] = []
            continue
        b, s = by_shard[full].pop(at)
        load[full] -= b
        load[low] += b
        moves.append((full, low, s))


def shard(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = 4,
    slack: float = 0.25,
    even_to: float = 0.01,
    slices: int = 1024,
    rows_per_bucket: int = 250_000,
) -> DataFrame:
    """Per document: doc_id, size, text_crc32, linked, shard, slot.

    size is the text's UTF-8 bytes plus one; sizes are evened per shard. slot
    counts from 0 in each shard without gaps. A null text has size 1, the
    checksum of the empty text and links with other null texts only; empty
    texts link with empty ones. Repeated rows are rows of their own with
    different slots; an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(spark, "shard")
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    src = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(text).isNull(), raw).alias("g1"),
        F.hash(F.col(text).isNull(), raw).alias("g2"),
    )
    rows = ws.stage(src.withColumn("h", F.xxhash64("doc_id", "text_crc32", F.lit(7))), "rows")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    limit = total / shards * (1 + slack)
    piece = max(1.0, total / shards / 3)
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.sum("size").alias("b")).where("n > 1")
    groups = ws.stage(groups.select("g1", "g2", F.ceil(F.col("b") / piece).cast("int").alias("salts")), "groups")
    tied = rows.join(groups, ["g1", "g2"], "left")
    start = F.pmod("h", F.lit(shards)).cast("int")
    now = ws.stage(
        tied.select(
            "doc_id", "size", "text_crc32", "g1", "g2", "h",
            F.col("salts").isNotNull().alias("linked"),
            F.pmod(F.xxhash64("h"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
            start.alias("shard"),
        ),
        "start",
    )
    key = ["g1", "g2", "salt"]

    def loads() -> list[float]:
        got = {r["shard"]: float(r["b"]) for r in now.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        return [got.get(s, 0.0) for s in range(shards)]

    def moved(accepted: list[tuple[int, int, int]], df: DataFrame, applies) -> DataFrame:
        table = spark.createDataFrame(accepted, "shard int, goal int, slice int")
        hit = df.join(F.broadcast(table.withColumn("go", F.lit(True))), ["shard", "goal", "slice"] if "goal" in df.columns else ["shard", "slice"], "left")
        return hit.withColumn("shard", F.when(applies & F.col("go"), F.col("goal")).otherwise(F.col("shard")))

    cols = ["doc_id", "size", "text_crc32", *key, "h", "linked", "shard"]
    for _ in range(rounds):
        cells = now.where("linked").groupBy(*key, "shard").agg(F.sum("size").alias("b"))
        goal = ws.stage(cells.groupBy(*key).agg(F.max(F.struct("b", F.pmod(F.xxhash64("g1", "salt", "shard"), F.lit(997)), "shard"))["shard"].alias("goal"), F.count("*").alias("k")).where("k > 1").drop("k"), "goals")
        wish = now.join(goal, key, "left").withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int"))
        wants = wish.where("goal is not null and goal <> shard")
        asked = [tuple(r) for r in wants.groupBy("shard", "goal", "slice").agg(F.sum("size").cast("double").alias("b")).collect()]
        accepted = _accept(asked, loads(), limit)
        if not accepted:
            ws.drop(goal)
            break
        new = ws.stage(moved(accepted, wish, F.col("linked")).select(*cols), "moved")
        ws.drop(now, goal)
        now = new
    # first what has no links; if that does not do, whole groups, by their key
    for movable, by in ((~F.col("linked"), F.xxhash64("h", F.lit(3))), (F.col("linked"), F.xxhash64(*key))):
        load = loads()
        if max(load) <= total / shards * (1 + even_to):
            break
        free = now.withColumn("slice", F.pmod(by, F.lit(slices)).cast("int"))
        sums = free.where(movable).groupBy("shard", "slice").agg(F.sum("size").cast("double").alias("b"))
        even = _even([tuple(r) for r in sums.collect()], load)
        if even:
            now = ws.stage(moved(even, free, movable).select(*cols), "even")
    buckets = max(16, n_rows // rows_per_bucket)
    placed = now.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(11)), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id"))
    out = placed.withColumn("within", within).join(first, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "linked", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"))
