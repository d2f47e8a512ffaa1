"""The streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from meridia.streaming.windows import distinct_identities, in_order, late_rows, upsert_stream, windowed_counts

DIR = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    return events, spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")


def test_windows(spark, tmp_path):
    events, s = stream(spark, tmp_path)
    q = windowed_counts(s, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == events.count()


def test_upserts_and_identities(spark, tmp_path):
    events, s = stream(spark, tmp_path)
    seen = []
    upsert_stream(distinct_identities(s, "ts", "event_id"), lambda df: seen.append(df.count()), f"{tmp_path}/ck").awaitTermination()
    assert sum(seen) == events.select("event_id").distinct().count()


def test_rows_in_order(spark, tmp_path):
    """Each key's rows come out in the order of their time, numbered, once the watermark has passed them."""
    events = spark.read.parquet(f"{DIR}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    for n, part in enumerate(events.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    spark.read.parquet(f"{tmp_path}/in0", f"{tmp_path}/in1").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    s = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    in_order(s, "ts", "event_type", "0 seconds").writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    last = events.agg(F.max("ts")).first()[0]
    for kind in {r["event_type"] for r in got}:
        mine = sorted((r["nth"], r["ts"], r["event_id"]) for r in got if r["event_type"] == kind)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1] for m in mine] == sorted(m[1] for m in mine)
    assert len(got) >= events.where(F.col("ts") < F.lit(last)).count() - 1


def test_late_rows_are_shown(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5)], "k string, t int")
    assert [r["t"] for r in late_rows(rows, "t", spark.createDataFrame([("a", 3)], "k string, final int"), "k").collect()] == [1]
