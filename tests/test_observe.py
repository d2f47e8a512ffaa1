"""Runs and micro-batches as rows, counted while their own action passes over the data."""

import time

import pytest
from pyspark.sql import functions as F

from meridia.operators import batch, observe


def test_runs(spark, tmp_path):
    told = []
    log = observe.RunLog(spark, f"file://{tmp_path}", (told.append, lambda row: told.append(observe.shown(row))))
    inputs = spark.range(20).select(F.col("id").alias("idx"))


    with log.run("batch") as run:
        got = run.watch(batch.batch_run(inputs.withColumn("x", F.col("idx")), lambda r: str(1 / (r["x"] % 5)) if r["x"] != 3 else None), **observe.outcome_counts())
        got.write.parquet(f"file://{tmp_path}/out")
    with log.run("idle") as run:
        run.watch(inputs, n=F.count(F.lit(1)))  # never read
    with pytest.raises(ZeroDivisionError):
        with log.run("broken"):
            1 / 0
    rows = {r["run"]: r for r in log.table().collect()}
    counts = batch.counts(spark.read.parquet(f"file://{tmp_path}/out")).first()
    assert rows["batch"]["metrics"] == counts.asDict() == {"total": 20, "success": 15, "failure": 4}
    assert rows["idle"]["metrics"] == {} and rows["broken"]["error"].startswith("ZeroDivisionError") and rows["batch"]["error"] is None and rows["batch"]["seconds"] > 0
    assert len(told) == 6 and '"run": "batch"' in told[1]


def test_streams(spark, tmp_path):
    log = observe.RunLog(spark, f"file://{tmp_path}")
    spark.range(30).write.parquet(f"{tmp_path}/in")
    listener = log.listener()
    spark.streams.addListener(listener)
    try:
        s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("seen", F.count_if(F.col("id") % 3 == 0).alias("third"))
        q = s.writeStream.format("noop").queryName("numbers").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if (tmp_path / "runs").exists() and list((tmp_path / "runs").glob("*.parquet")):
                break
            time.sleep(0.1)
        time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    got = [r["metrics"] for r in log.table().where("run = 'numbers'").collect()]
    assert sum(m["rows"] for m in got) == 30 and sum(m["seen.third"] for m in got) == 10
