"""Collecting news of a window from canned pages; boxes of parsed documents; spans."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from meridia.operators import chunking, collect, documents, usage
from meridia.sources.http import FetchPolicy

FAST = FetchPolicy(attempts=2, base_delay=0, jitter=0, spacing=0)


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def listing(*rows):
    card = '<div class="row newsCards"><a class="newsreleaseconsolidatelink" href="{}"><h3><small>{}</small>{}</h3></a></div>'
    return ('<input id="date" value="03/02/2024">' + "".join(card.format(*r) for r in rows)).encode()


def answers(pages, articles):
    """A transport over canned pages by number and articles by path; a page may be a list of answers, in turn."""

    def send(url, policy):
        if "news-releases-list" not in url:
            body = articles.get(url.rsplit("/", 1)[-1])
            return (200, {"content-type": "text/html; charset=utf-8"}, body, url) if body else (404, {}, b"", url)
        page = pages[int(url.split("page=")[1].split("&")[0])]
        body = page.pop(0) if isinstance(page, list) else page
        return (200, {"content-type": "text/html"}, body, url) if body is not None else (404, {}, b"", url)

    return send


def test_a_window(spark):
    pages = {
        1: [None, None, listing(("/a-1.html", "10:30 ET", "Late"), ("/b-2.html", "09:00 ET", "Good (NYSE: IBM)"), ("", "08:59 ET", "No link"))],
        2: listing(("/c-3.html", "08:00 ET", "Lost"), ("/d-4.html", "23:00 ET", "Before")),
        3: listing(("/never.html", "22:00 ET", "x")),
    }
    got = collect.collect_news(spark, utc(2024, 3, 2, 12), utc(2024, 3, 2, 15), answers(pages, {"b-2.html": b"<p>Body  text</p>"}), FAST, lambda s: None)
    docs = got.documents.collect()
    assert [(d["title"], d["body_text"], d["payload_id"], str(d["published_at"])) for d in docs] == [("Good (NYSE: IBM)", "Body text", "2", "2024-03-02 14:00:00")]
    assert docs[0]["ticker_hints"][0]["symbol"] == "IBM" and docs[0]["article_html"] is None and "b-2.html" in docs[0]["listing_html"]
    assert sorted((f["stage"], f["error_type"], f["message"]) for f in got.failures.collect()) == [("article_fetch", "http_status", "status 404"), ("discovery_parse", "invalid_content", "no link")]
    assert got.observed_count == 2 and not got.complete  # a row that cannot be read leaves the window open


def test_complete_windows(spark):
    pages = {1: listing(("/a-1.html", "09:00 ET", "A"), ("/b-2.html", "07:00 ET", "B"))}
    got = collect.collect_news(spark, utc(2024, 3, 2, 13), utc(2024, 3, 2, 15), answers(pages, {}), FAST, lambda s: None)
    assert got.complete and got.observed_count == 1 and got.documents.count() == 0  # a lost article does not open it


@pytest.mark.parametrize(
    "pages,message",
    [({1: b"<p>none</p>"}, "no rows"), ({1: listing(("/a", "09:00 ET", "A")), 2: listing(("/a", "09:00 ET", "A"))}, "did not advance"), ({1: [None] * 20}, "status 404"), ({1: b'<input id="date" value="x">'}, "does not match")],
)
def test_discovery_that_ends_early(spark, pages, message):
    seen, lost, complete = collect.discover(spark, utc(2024, 3, 1), utc(2024, 3, 3), answers(pages, {}), FAST, lambda s: None)
    assert not complete and message in lost.first()["message"] and seen.count() <= 1


def test_page_cap(spark):
    pages = {n: listing((f"/a-{n}.html", "09:00 ET", "A")) for n in range(1, 4)}
    _, lost, complete = collect.discover(spark, utc(2024, 1, 1), utc(2024, 3, 3), answers(pages, {}), FAST, lambda s: None, cap=3)
    assert not complete and "more than 3 pages" in lost.first()["message"]
    with pytest.raises(ValueError):
        collect.discover(spark, utc(2024, 1, 2), utc(2024, 1, 1), answers(pages, {}), FAST)


def test_parsed_pages_and_boxes(spark):
    pages = spark.createDataFrame([("d", 1, "one two"), ("d", 2, "")], "doc_id string, page_number int, text string")
    blocks = spark.createDataFrame([("d", 1, 0, "one", 9.0, 1.0, 2.0, 3.0, 4.0), ("d", 1, 1, "two", 9.0, 10.0, 2.0, 5.0, 6.0)], "doc_id string, page_number int, position int, text string, font_size double, x double, y double, w double, h double")
    got = {r["page_number"]: r["blocks"] for r in documents.parsed_pages(pages, blocks).collect()}
    assert [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in got[1]] == [(1.0, 2.0, 4.0, 6.0), (10.0, 2.0, 15.0, 8.0)] and got[2] == []
    with pytest.raises(Exception, match="contiguous"):
        documents.parsed_pages(pages.where("page_number = 2"), blocks).collect()
    box = chunking.chunks(documents.parsed_pages(pages, blocks), 1, 0).orderBy("position").collect()
    assert [r["text"] for r in box] == ["one", "two"] and all([b["x1"] for b in r["block_boxes"]] == [4.0, 15.0] for r in box)


def test_spans(spark):
    c = usage.SpanCollector("t")
    with pytest.raises(KeyError):
        with c.span("agent", "Writer"):
            with c.span("generation", "g", "m") as s:
                s["usage"] = {"input_tokens": 5, "output_tokens": 2}
            raise KeyError
    spans = c.spans(spark)
    assert usage.labels(spans).first()["label"] == "Writer"
    got = usage.roll_up(usage.in_order(usage.steps(spans))).first()
    assert (got["requests"], got["total_tokens"]) == (1, 7) and spans.where(F.col("parent_id").isNull()).count() == 1
