"""Requests of a host: how many at once, how far apart, how long to wait; and the data source."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from meridia.sources import http


class Server:
    """Counts requests in flight and notes when they began."""

    def __init__(self, answer, takes=0.02):
        self.answer, self.takes, self.lock = answer, takes, threading.Lock()
        self.now, self.most, self.began = 0, 0, []

    def __call__(self, url, policy):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.began.append(time.monotonic())
        time.sleep(self.takes)
        with self.lock:
            self.now -= 1
        return self.answer(url)


def page(url):
    return 200, {"content-type": "text/html"}, url.encode(), url


def test_two_requests_are_in_flight_and_spaced():
    server = Server(page, 0.05)
    policy = http.FetchPolicy(spacing=0.02, in_flight=2)
    rows = list(http.Host(policy, server).fetch([f"http://h/{i}" for i in range(20)]))
    assert [r["body"] for r in rows] == [f"http://h/{i}".encode() for i in range(20)] and server.most == 2
    assert all(b - a > 0.015 for a, b in zip(sorted(server.began), sorted(server.began)[1:]))
    one = Server(page)
    list(http.Host(http.FetchPolicy(spacing=0, in_flight=1), one).fetch([f"http://h/{i}" for i in range(5)]))
    assert one.most == 1


def test_a_host_that_asks_for_time_gets_it():
    """After Retry-After no request to the host begins, of whichever address."""
    asked = []

    def answer(url):
        if not asked:
            asked.append(time.monotonic())
            return 429, {"retry-after": "1"}, b"", url
        return page(url)

    server = Server(answer, 0.0)
    rows = list(http.Host(http.FetchPolicy(spacing=0.001, base_delay=0, jitter=0, in_flight=2), server).fetch([f"http://h/{i}" for i in range(6)]))
    assert all(r["status"] == 200 for r in rows) and [r["attempts"] for r in rows].count(2) == 1
    late = [b - asked[0] for b in server.began[2:]]  # one more may have begun together with the first
    assert all(x > 0.9 for x in late)


def transport(url, policy):
    if url.endswith("7"):
        return 404, {}, b"", url
    return 200, {"content-type": "text/html; charset=utf-8", "x-other": "1", "etag": "e"}, b"x" * 100_000, url


def test_fetch_keeps_bodies_in_tasks(spark):
    """200 articles of five hosts; the driver sees counts."""
    urls = spark.range(200).select(F.concat(F.lit("http://host"), F.col("id") % 5, F.lit(".test/"), F.col("id")).alias("url"))
    got = http.fetch(urls, http.FetchPolicy(attempts=1, spacing=0), "url", transport)
    row = got.agg(F.count("*").alias("n"), F.count_if(F.col("error_type") == "http_status").alias("lost"), F.sum(F.octet_length("body")).alias("size"), F.count_if(F.col("headers")["etag"] == "e").alias("kept")).first()
    assert (row["n"], row["lost"], row["size"], row["kept"]) == (200, 20, 180 * 100_000, 180)
    per = got.groupBy(http.host_of(F.col("url")).alias("h"), F.spark_partition_id().alias("p")).count().groupBy("h").count()
    assert per.where("count > 1").count() == 0  # a host is in one task
    assert http.fetch(urls.limit(0), None, "url", transport).count() == 0


class Canned(http.HttpDocuments):
    transport = staticmethod(transport)

    @classmethod
    def name(cls):
        return "canned_documents"


def test_data_source(spark):
    spark.dataSource.register(Canned)
    urls = "\n".join(f"http://host{i % 3}.test/{i}" for i in range(30))
    df = spark.read.format("canned_documents").option("urls", urls).option("attempts", "1").option("spacing", "0").load()
    assert df.rdd.getNumPartitions() == 3
    got = df.select("url", "status", "content_type", F.octet_length("body").alias("n")).collect()
    assert len(got) == 30 and {r["status"] for r in got} == {200, 404} and {r["content_type"] for r in got} == {"text/html", None}
    assert spark.read.format("canned_documents").option("urls", "").load().count() == 0
    with pytest.raises(Exception, match="unknown options"):
        spark.read.format("canned_documents").option("urls", urls).option("nonsense", "1").load().count()
