"""Sentences, and chunks of whole sentences, against a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meridia.operators import chunking

BLANK = " \t\n\x0b\x0c\r"


def plain_sentences(text):
    """Word by word: where may a sentence end?"""
    words = re.findall(f"[^{BLANK}]+[{BLANK}]*", text)
    short = "|".join(map(re.escape, chunking.ABBREVIATIONS))
    out, now = [], ""
    for i, w in enumerate(words):
        now += w
        bare = w.rstrip(BLANK)
        last = i + 1 == len(words)
        mark = re.search(r"[.!?…。！？][\"'”’»)\]]{0,3}$", bare) and not re.search(rf"(^|[(\[])({short}|[A-ZÄÖÜÉ])\.$", bare)
        if last or w.count("\n") >= 2 or (mark and not words[i + 1][0].islower()):
            out.append(now)
            now = ""
    return out


def plain_chunks(text, size, overlap):
    n_words = lambda s: len(re.findall(f"[^{BLANK}]+", s))
    parts = []
    for s in plain_sentences(text):
        if n_words(s) <= size:
            parts.append(s)
            continue
        for c in re.findall(rf"[^{BLANK}](?:.|\n)*?(?:(?<=[,;:，；：])[{BLANK}]+|(?<=[^{BLANK}])[{BLANK}]*\Z)", s):
            parts += [c] if n_words(c) <= size else re.findall(f"[^{BLANK}]+[{BLANK}]*", c)
    at = len(text) - len(text.lstrip(BLANK))
    out, a = [], 0
    starts = [at]
    for p in parts:
        starts.append(starts[-1] + len(p))
    while a < len(parts):
        b, used = a, 0
        while b < len(parts) and (b == a or used + n_words(parts[b]) <= size):
            used += n_words(parts[b])
            b += 1
        out.append((starts[a], text[starts[a] : starts[b]].rstrip(BLANK)))
        if b == len(parts):
            break
        c = b
        while c > a + 1 and sum(map(n_words, parts[c - 1 : b])) <= overlap and sum(map(n_words, parts[c - 1 : b + 1])) <= size:
            c -= 1
        a = c
    return out


PIECES = ["Dr.", "No.", "J.", "end.", "why?!", "Yes.", "(see", "Fig.", "3)", '"So."', "he", "said", "3.14", "list:", "one,", "two;", "é.", "Ä.", "。", "wait…", "e.g.", "(e.g.", "x"]
GAPS = [" ", " ", " ", "  ", "\n", "\n\n", " \n \n ", "\t", "\r\n"]


def texts(rng, n):
    for _ in range(n):
        yield rng.choice(["", " ", "\n\n"]) + "".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randint(0, 40))) + rng.choice(["", "end"])


@pytest.mark.parametrize("size,overlap", [(6, 3), (20, 0), (1, 0), (5, 4), (512, 64)])
def test_chunks_match_a_plain_version(spark, size, overlap):
    rows = [("d", i + 1, t) for i, t in enumerate([*texts(random.Random(size), 300), "", " \n ", "word " * 3000, "A b. " * 2000, "x" * 100_000])]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = {}
    for r in chunking.chunks(pages, size, overlap).orderBy("page_number", "position").collect():
        got.setdefault(r["page_number"], []).append((r["start_char"], r["text"]))
        assert r["end_char"] == r["start_char"] + len(r["text"]) and len(re.findall(r"\S+", r["text"])) <= size
    for _, page, text in rows:
        assert got.get(page, []) == plain_chunks(text, size, overlap), text[:200]


def test_sentences_keep_the_text(spark):
    rows = list(enumerate(texts(random.Random(1), 200)))
    got = spark.createDataFrame(rows, "i int, text string").select("i", chunking.sentences(F.col("text")).alias("s")).collect()
    for (_, text), r in zip(rows, sorted(got)):
        assert "".join(r["s"]) == text.lstrip(BLANK) and r["s"] == plain_sentences(text)


def test_borders_and_what_pages_carry(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double,position:int>"
    pages = spark.createDataFrame([("d", 1, "A cat sat. It slept well. Then it left!", [(0.0, 0.0, 1.0, 1.0, 0), (0.0, 2.0, 1.0, 3.0, 1)], "s.png", ["i.png"]), ("d", 2, " ", [], None, None)], f"doc_id string, page_number int, text string, blocks array<{box}>, screenshot_path string, image_paths array<string>")
    got = chunking.chunks(pages, 7, 3).orderBy("position").collect()
    assert [r["text"] for r in got] == ["A cat sat. It slept well.", "It slept well. Then it left!"]
    assert all(len(r["block_boxes"]) == 2 and r["screenshot_path"] == "s.png" and r["image_paths"] == ["i.png"] for r in got)
    assert len({r["chunk_id"] for r in got}) == 2
    for bad in ((3, 3), (0, 0), (3, -1)):
        with pytest.raises(ValueError):
            chunking.chunks(pages, *bad)
    assert chunking.chunks(pages.limit(0)).count() == 0


def test_other_tokens(spark):
    """Any measure of a text may be the budget; a word over it is a chunk of its own."""
    pages = spark.createDataFrame([("d", 1, "aa bb cccccccccccc dd")], "doc_id string, page_number int, text string")
    got = chunking.chunks(pages, 6, 0, tokens=lambda t: F.length(F.regexp_replace(t, r"\s", ""))).orderBy("position").collect()
    assert [r["text"] for r in got] == ["aa bb", "cccccccccccc", "dd"]
