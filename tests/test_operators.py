"""Operators on small tables."""

import hashlib
import json
import random
import re
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from meridia.operators import batch, documents, integrity, news, ranking, search, trees, usage
from meridia.operators.library import KnowledgeLibrary
from meridia.plans.schemas import SPAN, STORE
from meridia.sources import feeds, files, html, http, papers


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def test_query_validation():
    for bad in ({"text": " "}, {"text": "x", "top_k": 0}, {"text": "x", "as_of": datetime(2024, 1, 1)}):
        with pytest.raises(ValueError):
            search.SemanticQuery(**bad)


def test_availability_fails_closed(spark):
    rows = [("a", utc(2024, 1, 1), utc(2024, 1, 2)), ("b", utc(2024, 1, 1), None), ("c", utc(2024, 1, 3), utc(2024, 1, 3))]
    df = spark.createDataFrame(rows, "target_id string, as_of timestamp, available_at timestamp")
    hits = lambda **k: sorted(r[0] for r in search.matching(df, search.SemanticQuery("x", **k)).collect())
    assert hits() == ["a", "b", "c"]
    assert hits(as_of=utc(2024, 1, 1)) == ["a", "b"]
    assert hits(available_at=utc(2024, 1, 2)) == ["a"]


def test_search_does_not_embed_for_nothing(spark):
    df = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 1.0]), ("c", "x", [0.0, 1.0]), ("d", "x", [2.0, 0.0])], "target_id string, item_type string, embedding array<float>")
    got = search.search(df, search.SemanticQuery("q", top_k=3), lambda _: [1.0, 0.0]).collect()
    assert [r["target_id"] for r in got] == ["a", "d", "b"]

    def fail(_):
        raise AssertionError

    assert search.search(df, search.SemanticQuery("q", item_types=("y",)), fail).count() == 0
    with pytest.raises(Exception, match="dimension"):
        search.rank(df, [1.0], 1).collect()


def test_bm25_arguments(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta")], "doc_id long, text string")
    assert [r["doc_id"] for r in ranking.bm25(df, "beta").collect()] == [2, 1]
    with pytest.raises(ValueError):
        ranking.bm25(df, " ")


def listing(spark, rows):
    return spark.createDataFrame([(i // 3, i, date(2024, 3, 2), s) for i, s in enumerate(rows)], "page_number int, row_number int, page_date date, timestamp_text string")


def test_listing_times_in_segments(spark):
    """However a listing is cut into segments, its times are those of one pass over it."""
    rng = random.Random(9)
    stamps = lambda: rng.choice([f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02} ET"] * 6 + [f"Mar {rng.randint(1, 28)}, 2024, {rng.randint(0, 23):02}:30 ET", "never", None, "25:00 ET"])
    rows = [(f, n // 3, n, datetime(2024, 5, 1 + n % 3).date(), stamps()) for f in ("a", "b", None) for n in range(120)]
    df = spark.createDataFrame(rows, "feed string, page_number int, row_number int, page_date date, timestamp_text string")
    got = {}
    for pages in (1, 4, 1000):
        out = news.listing_times(df, feed="feed", pages=pages)
        got[pages] = sorted(map(str, out.select("feed", "row_number", F.date_format("published_at", "yyyy-MM-dd HH:mm"), "time_error").collect()))
    assert got[1] == got[4] == got[1000]
    want = []
    for feed in ("a", "b", None):
        day = clock = None
        for f, _, n, date, stamp in rows:
            if f != feed:
                continue
            at = re.fullmatch(r"(?:Mar (\d+), 2024, )?(\d\d):(\d\d) ET", stamp or "")
            if not at or int(at[2]) > 23:
                want.append((feed, n, None))
                continue
            now = (int(at[2]), int(at[3]))
            if at[1]:
                day = datetime(2024, 3, int(at[1])).date()
            elif day is None:
                day = date
            elif now > clock:
                day -= timedelta(days=1)
            clock = now
            want.append((feed, n, f"{day} {now[0]:02}:{now[1]:02}"))
    shown = news.listing_times(df, feed="feed", pages=4).select("feed", "row_number", F.date_format(F.from_utc_timestamp("published_at", news.ZONE), "yyyy-MM-dd HH:mm").alias("p")).collect()
    spring = "2024-03-10 02:"  # the hour that the zone leaves out
    assert sorted(str(tuple(r)) for r in shown if not (r["p"] or "").startswith(("2024-03-10 03:", spring))) == sorted(str(w) for w in want if not (w[2] or "").startswith(("2024-03-10 03:", spring)))


def test_listing_times(spark):
    rows = listing(spark, ["00:10 ET", "00:10 ET", "00:01 ET", "23:59 ET", "bad", "23:58 ET", "Feb 28, 2024, 12:00 ET", "11:00 ET", "11:30 ET"])
    got = [r[0] for r in news.listing_times(rows).orderBy("row_number").select(F.date_format("published_at", "MM-dd HH:mm")).collect()]
    assert got == ["03-02 05:10", "03-02 05:10", "03-02 05:01", "03-02 04:59", None, "03-02 04:58", "02-28 17:00", "02-28 16:00", "02-27 16:30"]


def test_coverage(spark):
    rows = news.listing_times(listing(spark, ["00:10 ET", "00:00 ET"]))
    state = lambda at: news.coverage(rows, F.lit(at)).first().asDict()
    assert not state(utc(2024, 3, 2, 5, 0))["complete"]  # a row equal to the start does not end the scan
    assert state(utc(2024, 3, 2, 5, 1))["complete"]
    with pytest.raises(ValueError):
        news.in_window(F.col("x"), datetime(2024, 1, 1), utc(2024, 1, 2))


def test_pages_to_read(spark):
    rows = [(1, utc(2024, 1, 9), "a", 3), (2, utc(2024, 1, 8), "b", 3), (3, utc(2024, 1, 1), "c", 3), (4, utc(2023, 1, 1), "d", 3)]
    df = spark.createDataFrame(rows, "page_number int, oldest timestamp, fingerprint string, n_rows int")
    got = news.pages_to_read(df, F.lit(utc(2024, 1, 2))).orderBy("page_number").collect()
    assert [(r["page_number"], r["outcome"]) for r in got] == [(1, "more"), (2, "more"), (3, "crossed")]
    same = news.pages_to_read(df.withColumn("fingerprint", F.lit("a")), F.lit(utc(2020, 1, 1)))
    assert [r["outcome"] for r in same.orderBy("page_number").collect()] == ["more", "repeated"]


def test_prepare_news(spark):
    rows = [("Big (NYSE: IBM)\nBig (NYSE: IBM)", "press_release", "http://a.b/x-1.html?utm_x=1", " T  ", "2024-01-01", "7", {"k": "v", "e": ""}), ("  ", "press_release", None, None, None, None, {})]
    df = spark.createDataFrame(rows, "body_text string, source_type string, source_url string, title string, published_at string, payload_id string, metadata map<string,string>")
    docs, failed = news.split_outcomes(news.prepare(df))
    d = docs.first()
    assert d["body_text"] == "Big (NYSE: IBM)" and d["title"] == "T" and d["metadata"] == {"k": "v"} and d["source_url"] == "http://a.b/x-1.html"
    assert d["identity"] == "wire:" + hashlib.sha256(b"7").hexdigest() and d["ticker_hints"][0]["symbol"] == "IBM"
    assert [r["message"] for r in failed.collect()] == ["empty body"]


def test_observations(spark):
    df = spark.createDataFrame([("/news/x-123.html", "A"), (None, "B"), ("/y", "")], "href string, title string")
    got = news.observations(df, "https://site.test").collect()
    assert [(r["payload_id"], r["error"]) for r in got] == [("123", None), (None, "no link"), (None, "no title")]


def test_outline(spark):
    rows = [("d", p, 1000.0, y, i, t, s) for p in (1, 2, 3) for i, (y, t, s) in enumerate([(10.0, "Journal of X", 9.0), (300.0, f"{p}. Part {p} begins", 14.0), (400.0, "body text that is long enough to count", 10.0), (940.0, f"- {p + 9} -", 9.0), (950.0, f" {p + 4} ", 9.0)])]
    blocks = spark.createDataFrame(rows, "doc_id string, page_number int, page_height double, y0 double, position int, text string, font_size double")
    n = spark.createDataFrame([("d", 3)], "doc_id string, n_pages int")
    headers = documents.repeated_headers(blocks, n)
    assert [r["header"] for r in headers.collect()] == ["journal of x"]
    heads = documents.headings(blocks, documents.body_font(blocks), headers).orderBy("page_number").collect()
    assert [(r["text"], r["level_hint"]) for r in heads] == [(f"{p}. Part {p} begins", 1) for p in (1, 2, 3)]
    assert documents.page_offset(blocks).first()["printed_page_offset"] == -4
    toc = spark.createDataFrame([("d", 1, "Contents\nIntro .... 1\nEnd .... 9"), ("d", 2, "Contents\nnothing")], "doc_id string, page_number int, text string")
    assert [r["page_number"] for r in documents.contents_pages(toc).collect()] == [1]


def test_quotes_of_any_length(spark, capsys):
    """Quotes of parts of words, one word, two and many, frequent and missing ones; the plan has no nested loop."""
    rng = random.Random(4)
    words = ["the", "cat", "catalogue", "scat", "a", "sat", "é😀", "on", "mat."]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(120)] + ["", None, "lonely"]
    quotes = ["the", "cat", "a", "c", "at s", "t a", "the cat", "cat sat on", "at the cat s", "zebra", "the zebra cat", "é", "😀 on", "mat.", "on\nmat.", "e  c", "the " * 3, None, "lonely", " "]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").withColumn("word", F.lit(1))
    asked = spark.createDataFrame(list(enumerate(quotes)) + [(99, "cat")], "nth int, quote string")
    df = documents.quotes_in(chunks, asked, "chunk_id")
    got = sorted((r["chunk_id"], r["nth"], r["offset"]) for r in df.collect())
    assert got == sorted((i, n, t.index(q)) for i, t in enumerate(texts) for n, q in [*enumerate(quotes), (99, "cat")] if t and q and q.strip() and q in t)
    df.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_citations(spark):
    c = spark.createDataFrame([("o", "c1", 1, "two", 0), ("o", "c1", 1, "two", 1), ("o", "c1", 9, "two", 2), ("o", "zz", 1, None, 3), ("o", "c1", 1, None, 4)], "owner string, chunk_id string, page int, quote string, nth int")
    chunks = spark.createDataFrame([("c1", "one two", [1, 2])], "chunk_id string, text string, pages array<int>")
    assert [r["valid"] for r in documents.quotes_at(c, chunks).orderBy("nth").collect()] == [True, True, False, False, True]
    assert documents.distinct_citations(c, "nth").count() == 4


NODES = "tree_id string, node_id string, parent_id string, position int, children_ids array<string>, pages array<int>, content string"


def test_trees(spark):
    rows = [("t", "r", None, 0, ["b", "a"], [1, 2], None), ("t", "a", "r", 1, [], [1], "A"), ("t", "b", "r", 0, ["c"], [2], None), ("t", "c", "b", 0, [], [2], "C")]
    n = spark.createDataFrame(rows, NODES)
    assert trees.violations(n, spark.createDataFrame([("t", 1), ("t", 2)], "tree_id string, page int")).count() == 0
    walked = trees.walk(spark, n)
    assert [r["node_id"] for r in walked.orderBy("order").collect()] == ["r", "b", "c", "a"]
    assert sorted(map(str, trees.walk_sql(spark, n).collect())) == sorted(map(str, walked.collect()))
    assert {r["node_id"]: r["text"] for r in trees.leaf_text(walked, n).collect()} == {"r": "C\n\nA", "b": "C", "a": "A", "c": "C"}
    assert trees.find_path(walked, F.lit("c")).first()["path"] == ["r", "b", "c"]
    assert [r["child"] for r in trees.children(n).where("parent = 'r'").collect()] == ["b", "a"]


@pytest.mark.parametrize(
    "change,rule",
    [
        (("t", "a", "zz", 1, [], [1], "A"), "known parent"),
        (("t", "a", None, 1, [], [1], "A"), "one root"),
        (("t", "a", "r", 0, [], [1], "A"), "unique position"),
        (("t", "a", "r", 1, ["q"], [1], "A"), "child names parent"),
        (("t", "a", "b", 1, [], [2], "A"), "parent names child"),
        (("t", "a", "r", 1, [], [0], "A"), "positive page"),
        (("t", "a", "r", 1, [], [7], "A"), "page within parent"),
    ],
)
def test_tree_rules(spark, change, rule):
    rows = [("t", "r", None, 0, ["b", "a"], [1, 2, 0], None), change, ("t", "b", "r", 0, [], [2], "B")]
    assert rule in {r["rule"] for r in trees.violations(spark.createDataFrame(rows, NODES)).collect()}


def test_tree_rules_broadcast_nothing(spark):
    """sides that grow with the trees do not go through the driver, however small their shuffled files are."""
    rows = [("t", "r", None, 0, ["b", "a"], [1, 2, 0], None), ("t", "a", "r", 1, [], [1], "A"), ("t", "b", "r", 0, [], [2], "B")]
    n = spark.createDataFrame(rows, NODES)
    for df in (trees.violations(n, n.select("tree_id", F.explode("pages").alias("page")), n.select("tree_id", F.lit("r").alias("root_id"))), trees.walk(spark, n)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_cycle_is_unreachable(spark):
    rows = [("t", "r", None, 0, [], [], None), ("t", "a", "b", 0, ["b"], [], None), ("t", "b", "a", 0, ["a"], [], None)]
    assert {r["node_id"] for r in trees.violations(spark.createDataFrame(rows, NODES)).where("rule = 'reachable'").collect()} == {"a", "b"}


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 nodes below each other: no cap, and as many rounds as the depth has bits."""
    from meridia.operators import ancestry

    rounds, cut = [], ancestry.cut
    monkeypatch.setattr(ancestry, "cut", lambda df: rounds.append(1) or cut(df))
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    i = F.col("id")
    n = spark.range(10_000).select(F.lit("t").alias("tree_id"), name(i).alias("node_id"), F.when(i > 0, name(i - 1)).alias("parent_id"), F.lit(0).alias("position"))
    got = ancestry.climb(n, "tree_id", "node_id", "parent_id", F.col("parent_id").isNull())
    assert got.agg(F.max("steps")).first()[0] == 9_999 and got.count() == 10_000 and len(rounds) <= 16
    loop = n.where("node_id <> 'n0'").withColumn("parent_id", F.when(F.col("node_id") == "n1", "n9999").otherwise(F.col("parent_id")))
    assert ancestry.climb(loop, "tree_id", "node_id", "parent_id", F.col("parent_id").isNull()).count() == 0
    deep = trees.walk(spark, n.where("cast(substr(node_id, 2) as int) < 300"))
    assert deep.agg(F.max("depth")).first()[0] == 299 and deep.where("node_id = 'n299'").first()["path"] == [f"n{k}" for k in range(300)]
    spans = n.select(F.col("node_id").alias("span_id"), "parent_id", F.col("tree_id").alias("trace_id"), F.when(F.col("node_id") == "n0", "agent").when(F.col("node_id") == "n999", "generation").otherwise("task").alias("type"), F.col("node_id").alias("name"))
    assert [tuple(r) for r in usage.labels(spans).collect()] == [("n999", "n0")]


def test_feeds_are_read_item_by_item(spark, monkeypatch):
    """of a feed with many items only a part is held as elements; its title and its errors may come last."""
    items = "".join(f"<item><title>i{i}</title><link>l{i}</link></item>" for i in range(3000))
    whole = f"<rss><channel>{items}<title>T</title></channel></rss>"
    monkeypatch.setattr(feeds, "PART", 50)
    assert max(len(root) + sum(map(len, root)) for root, _, _ in feeds._children(whole)) <= 4
    rows = feeds.parse_feed(whole.encode(), "u")
    assert [(r["title"], r["id"], r["feed_title"]) for r in rows] == [(f"i{i}", f"l{i}", "T") for i in range(3000)]
    with pytest.raises(ValueError, match="no XML"):
        next(feeds.feed_rows(whole[:-1], "u"))
    df = spark.createDataFrame([("u", bytearray(whole.encode())), ("v", bytearray(whole[:-1].encode()))], "url string, body binary")
    assert sorted((r["feed_url"], r["n"], r["bad"]) for r in feeds.read_feeds(df).groupBy("feed_url").agg(F.count("*").alias("n"), F.count("error").alias("bad")).collect()) == [("u", 3000, 0), ("v", 1, 1)]


@pytest.mark.parametrize("build", ["html", "vectors", "nfkc"])
def test_python_batches_are_bounded_in_bytes(spark, build):
    """long rows come in small batches, whatever number of rows a batch may have."""
    import pandas as pd

    from meridia.functions import text
    from meridia.functions.batches import BATCH
    from meridia.operators.providers import embed
    from meridia.sources.html import html_text

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 256 << 20)
    {"html": html_text, "vectors": embed, "nfkc": text.normalize_unicode}[build](F.col("x"))
    rows = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    got = spark.range(0, 200, 1, 1).select(rows(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 100_000))).alias("n")).agg(F.max("n")).first()[0]
    assert got <= BATCH // 100_000 + 1


def test_item_rules_join_each_side_once(spark):
    """the same rows as rule by rule, with records shuffled once and counts joined once for all rules."""
    from meridia.operators import integrity

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    items = spark.createDataFrame([("a", "tree", "p", h("p"), 2, 3), ("b", "flat", "p", "x", 0, 1), ("b", "flat", "p", h("p"), 0, 1), (None, "tree", "p", h("p"), 1, 0)], "item_id string, item_shape string, payload_json string, canonical_hash string, node_count int, target_count int")
    nodes = spark.createDataFrame([("a", "n1", "p", h("p")), ("z", "n2", "p", "x"), (None, "n3", "p", h("p"))], "item_id string, node_id string, payload_json string, content_hash string")
    records = spark.createDataFrame(
        [("a", "t1", "m", h("m"), h("p"), [1.0]), ("a", "t2", "m", "x", h("p"), [1.0, 2.0]), ("b", "t3", "m", h("m"), h("p"), [1.0]), ("z", "t4", "m", h("m"), None, None), (None, "t5", "m", h("m"), "x", [1.0])],
        "item_id string, target_id string, matched_text string, projection_hash string, item_canonical_hash string, embedding array<double>",
    )
    got = integrity.item_violations(items, nodes, records)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted([
        ("record without item", "z", "t4"), ("record of an older item", "b", "t3"), ("node count", "a", "1"), ("node count", "None", "0"), ("target count", "a", "2"), ("one dimension", "a", "2"),
        ("node without item", "z", "n2"), ("payload hash", "b", "x"), ("node hash", "z", "n2"), ("projected text", "a", "t2"),
    ])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4


def test_budget(spark):
    df = spark.createDataFrame([("k", i, "t", "s" * 100) for i in range(10)], "k string, n int, title string, s string")
    r = trees.budgeted(df, 100, "k", "n", "title", "s").first()
    assert r["truncated"] and len(r["serialised"]) <= 400 and len(json.loads(r["serialised"])) == 3
    assert not trees.budgeted(df, 10_000, "k", "n", "title", "s").first()["truncated"]


def test_flat_groups(spark):
    got = [spark.range(1).select(trees.flat_groups(F.lit(n), m)).first()[0] for n, m in ((10, 4), (3, 10), (0, 5), (5, 1))]
    assert got == [4, 1, None, None]


def test_batch(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "idx long, v int")

    def flow(row):
        if row["v"] == 1:
            raise ValueError("one")
        return None if row["v"] == 2 else "ok"

    done = batch.batch_run(df, flow, concurrency=2)
    assert batch.counts(done).first().asDict() == {"total": 9, "success": 3, "failure": 3}
    assert [r["idx"] for r in batch.errors(done).collect()] == [1, 4, 7]
    with pytest.raises(Exception, match="one"):
        batch.batch_run(df, flow, on_error="raise").collect()


def test_usage(spark):
    rows = [
        ("t", None, "x", "task", "job", None, "2024-01-01T00:00:00", "2024-01-01T01:00:00", {"input_tokens": 999}, None),
        ("a", "t", "x", "agent", "Writer", None, None, None, None, None),
        ("g", "a", "x", "generation", "g", "m", "2024-01-01T00:00:00", "2024-01-01T00:00:10", {"prompt_tokens": 100, "completion_tokens": 50, "total_tokens": 150}, None),
        ("r", "g", "x", "response", "r", None, "2024-01-01T00:00:05", "2024-01-01T00:00:20", None, ("m2", (200, 80, None))),
    ]
    spans = spark.createDataFrame(rows, SPAN)
    got = usage.roll_up(usage.steps(spans)).first()
    assert (got["requests"], got["input_tokens"], got["output_tokens"], got["total_tokens"], got["wall_seconds"], got["busy_seconds"]) == (2, 300, 130, 430, 20.0, 25.0)
    assert {r["span_id"]: r["label"] for r in usage.labels(spans).collect()} == {"g": "Writer", "r": "Writer"}


def item(spark, item_id, payload, targets=1):
    h = hashlib.sha256(payload.encode()).hexdigest()
    items = spark.createDataFrame([(item_id, "news", "news", "flat", "1.0", payload, h, 0, targets)], STORE["items"])
    cols = {"target_id": f"item:{item_id}", "item_id": item_id, "item_type": "news", "matched_text": payload, "item_canonical_hash": h, "embedding": [1.0, float(len(payload))]}
    records = spark.createDataFrame([tuple(cols.get(f.name) for f in STORE["records"])], STORE["records"])
    return items, records


def test_library(spark, tmp_path):
    with KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib") as lib:
        for name, payload in (("a", '{"v":1}'), ("b", '{"v":2}')):
            items, records = item(spark, name, payload)
            lib.put(items, None, records)
        assert lib.get("a") == {"v": 1}
        lib.check()
        items, records = item(spark, "a", '{"v":3333}')
        lib.put(items, None, records)
        assert lib.get("a") == {"v": 3333} and lib.table("items").count() == 2
        assert [r["target_id"] for r in lib.search(search.SemanticQuery("q", top_k=1), lambda _: [1.0, 7.0]).collect()] == ["item:b"]
        with pytest.raises(ValueError, match="no columns"):
            lib.put(items.withColumn("extra", F.lit(1)))
        lib.delete("b")
        with pytest.raises(KeyError):
            lib.delete("b")
        with pytest.raises(integrity.StaleStoreError, match="target count"):
            lib.put(items)  # would lose its record
        assert KnowledgeLibrary.open(spark, lib.root).version == lib.version
    with pytest.raises(RuntimeError):
        lib.table("items")


def test_artifacts(spark, tmp_path):
    lib = KnowledgeLibrary.open(spark, f"file://{tmp_path}/lib")
    row = lambda t, **k: spark.createDataFrame([tuple(k.get(f.name) for f in STORE[t])], STORE[t])
    art = lambda k, body, n: row("artifacts", artifact_id=k, source_revision_id="s", artifact_kind=k, payload_json=body, target_count=n)
    none = {n: spark.createDataFrame([], STORE[n]) for n in ("members", "lineage")}
    lib.put_artifacts(art("paper_chunk_set", "{}", 1), row("members", artifact_id="paper_chunk_set", member_id="m", payload_json='{"text":"x"}'), none["lineage"], None, row("sources", source_revision_id="s"))
    lib.put_artifacts(art("paper_summary", '{"summary":"y","derived_from":[{"artifact_id":"paper_chunk_set"}]}', 1), none["members"], row("lineage", artifact_id="paper_summary", input_artifact_id="paper_chunk_set", relation="generated_from"))
    lib.check()
    assert lib.paper("s").count() == 2 and lib.table("sources").count() == 1
    loc = spark.createDataFrame([("s", "paper_chunk_set", "paper_chunk_set", "m")], "source_revision_id string, artifact_kind string, artifact_id string, member_id string")
    assert lib.resolve(loc).first()["payload_json"] == '{"text":"x"}'
    with pytest.raises(KeyError):
        lib.resolve(loc.withColumn("member_id", F.lit("zz")))


def test_html():
    assert html.to_text("<html><head><title>x</title></head><body><nav>n</nav><h2>T  a</h2><p>b<br>c &amp; d</p><ul><li>e</li></ul><script>z</script></body></html>") == "## T a\n\nb\nc & d\n\n- e"
    assert html.to_text("  ") == "" and html.to_text(None) == ""


def test_feeds(spark):
    rss = b"<rss><channel><item><title>A</title><link>http://x/1</link><guid>g1</guid><pubDate>Mon, 15 Apr 2024 10:30:00 GMT</pubDate></item><item><link>http://x/2</link><pubDate>never</pubDate></item></channel></rss>"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><link rel="self" href="http://x/s"/><link href="http://x/a"/><updated>2024-04-15T10:30:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("u1", bytearray(rss)), ("u2", bytearray(atom))], "url string, body binary")
    got = feeds.read_feeds(df).orderBy("url").collect()
    assert [(r["url"], r["id"], str(r["published_at"])) for r in got] == [("http://x/1", "g1", "2024-04-15 10:30:00"), ("http://x/2", "http://x/2", "None"), ("http://x/a", "i", "2024-04-15 10:30:00")]
    odd = feeds.read_feeds(df.unionByName(spark.createDataFrame([("u3", bytearray(b"<rss"))], "url string, body binary")))
    assert [(r["feed_url"], "no XML" in r["error"]) for r in odd.where("error is not null").collect()] == [("u3", True)] and odd.count() == 4
    for bad in (b"", b"<x/>", b"<rss", b'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"/>'):
        with pytest.raises(ValueError):
            feeds.parse_feed(bad, "u")


def test_listing_html():
    row = '<div class="row newsCards"><div><a class="newsreleaseconsolidatelink" href="/x-1.html"><h3><small>00:10 ET</small>\n Title  one &amp; two</h3><small>read</small></a></div></div>'
    page = f'<p>\n<input id="date" value="03/02/2024">{row}<div class="row">no</div>'
    assert feeds.parse_listing(page) == ("03/02/2024", [{"href": "/x-1.html", "title": "Title one & two", "timestamp_text": "00:10 ET", "raw_html": row}])


def test_http():
    policy = http.FetchPolicy(jitter=0)
    answers = iter([(503, {"retry-after": "7"}, b"", ""), (200, {"content-type": "Text/HTML; charset=x"}, b"hi", "http://f")])
    waits = []
    row = http.fetch_one("http://a", policy, lambda u, p: next(answers), waits.append)
    assert (row["status"], row["content_type"], row["attempts"], waits) == (200, "text/html", 2, [7.0])

    def slow(u, p):
        raise TimeoutError("slow")

    assert http.fetch_one("http://a", policy, slow, waits.append)["error_type"] == "attempts_exhausted"
    assert http.fetch_one("http://a", policy, lambda u, p: (404, {}, b"", ""), waits.append) | {} == http.fetch_one("http://a", policy, lambda u, p: (404, {}, b"", ""), waits.append)
    assert http.fetch_one("http://a", http.FetchPolicy(max_bytes=1), lambda u, p: (200, {}, b"xx", u))["error_type"] == "value"
    assert policy.delay(3) == 2.0 and http.retryable(429) and not http.retryable(404)


def test_files_and_assets(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.bin").write_bytes(b"\0")
    got = {r["path"][-5:]: r for r in files.text_of(files.read_files(spark, str(tmp_path))).collect()}
    assert got["b.bin"]["error"] and got[".html"[-5:]]["text"] == "x"
    df = spark.createDataFrame([("s", "raw", None, bytearray(b"a")), ("s", "raw", None, bytearray(b"a"))], "source_revision_id string, kind string, page_number int, blob binary")
    assert files.register_assets(df).count() == 1


def test_paper_metadata(spark):
    body = json.dumps({"message": {"DOI": "10.1/x", "title": ["T", "U"], "container-title": [], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published": {"date-parts": [[2024, 5]]}}})
    r = papers.doi_metadata(spark.createDataFrame([(bytearray(body.encode()),)], "body binary")).first()
    assert (r["title"], r["container"], r["authors"], str(r["published"])) == ("T", None, ["A B", "C"], "2024-05-01")
