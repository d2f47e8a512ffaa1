"""Page-structured documents: chunks, outline signals, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_space, printed_page, strip

# fixed values: numbered headings, lines of a table of contents, page numbers that stand alone
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]?\s+\S"
ENTRY = r"^.{2,}?\.{2,}\s*\d+\s*$"
PAGE_NUMBER = r"(?i)^\s*(\d{1,4}|[ivxlcdm]{1,8})\s*$"


def pages_of(docs: DataFrame, size: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_number, text): texts cut into pages of a fixed number of characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))
    return docs.select(key, F.posexplode(cut).alias("n", "text")).select(key, (F.col("n") + 1).alias("page_number"), "text")


def parsed_pages(pages: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages of parsed documents (key, page_number, width, height, text) with their blocks as boxes; empty pages stay.

    blocks: key, page_number, position, text, font_size, and x, y, w, h of the
    box, which becomes x0, y0, x1, y1. Pages that are not 1, 2, ... are an error.
    """
    boxed = blocks.groupBy(key, "page_number").agg(
        F.array_sort(F.collect_list(F.struct("position", "text", "font_size", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")))).alias("blocks")
    )
    bad = pages.groupBy(key).agg(F.count("*").alias("n"), F.min("page_number").alias("lo"), F.max("page_number").alias("hi"), F.countDistinct("page_number").alias("k"))
    fine = bad.select(key, F.when((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("k") == F.col("n")), True).otherwise(F.raise_error(F.concat(F.lit("pages are not contiguous: "), F.col(key).cast("string")))).alias("_ok"))
    empty = F.array().cast(boxed.schema["blocks"].dataType)
    return pages.join(fine, key).where("_ok").drop("_ok").join(boxed, [key, "page_number"], "left").withColumn("blocks", F.coalesce("blocks", empty))


def page_assets(pages: DataFrame, assets: DataFrame, key: str = "source_revision_id") -> DataFrame:
    """Pages with the ids of their assets, in order; none is an empty list."""
    named = assets.where("page_number is not null").groupBy(key, "page_number").agg(F.array_sort(F.collect_set("asset_id")).alias("asset_ids"))
    return pages.join(named, [key, "page_number"], "left").withColumn("asset_ids", F.coalesce("asset_ids", F.array().cast("array<string>")))


def finding_violations(groups: DataFrame, findings: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, group, chunk_index, rule) of findings that break a rule: in their group, on a page of their chunk, quote in its text.

    groups: key, group, start, count; findings: key, group, chunk_index, page,
    quote; chunks: key, chunk_index, pages, text. Groups are ranges, but each
    finding has one, so the range is a test after an equi-join.
    """
    both = findings.join(groups, [key, "group"], "left").join(chunks, [key, "chunk_index"], "left")
    inside = F.coalesce((F.col("chunk_index") >= F.col("start")) & (F.col("chunk_index") < F.col("start") + F.col("count")), F.lit(False))
    rule = (
        F.when(~inside, "chunk outside its group")
        .when(~F.coalesce(F.array_contains("pages", F.col("page")), F.lit(False)), "page outside its chunk")
        .when(F.col("quote").isNotNull() & ~F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)), "quote not in its chunk")
    )
    return both.withColumn("rule", rule).where("rule is not null").select(key, "group", "chunk_index", "rule")


def page_text(pages: Column) -> Column:
    """The pages' texts with a blank line between."""
    return F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n")


def body_font(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, body_size): exact median size of blocks of 20 characters or more."""
    return blocks.where((F.length(strip(F.col("text"))) >= 20) & F.col("font_size").isNotNull()).groupBy(key).agg(F.median("font_size").alias("body_size"))


def repeated_headers(blocks: DataFrame, n_pages: DataFrame, key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """(key, header, k): texts in the top 12 % of at least two pages and of half of all, with their pages; blocks have y0 and page_height."""
    top = blocks.where(F.col("y0") <= F.col("page_height") * 0.12).select(key, F.lower(normalize_space(F.col("text"))).alias("header"), "page_number").where("header <> ''")
    seen = top.groupBy(key, "header").agg(F.countDistinct("page_number").alias("k")).where("k >= 2")
    return seen.join(n_pages, key).where(F.col("k") >= F.col("n_pages") * share).select(key, "header", "k")


def headings(blocks: DataFrame, sizes: DataFrame, headers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_number, text, level_hint, font_size) of blocks that look like headings."""
    rows = blocks.withColumn("text", normalize_space(F.col("text"))).where((F.col("text") != "") & (F.length("text") <= 120))
    rows = rows.withColumn("header", F.lower("text")).join(headers, [key, "header"], "left_anti").join(sizes, key, "left")
    number = F.regexp_extract("text", NUMBERED, 1)
    large = F.coalesce(F.col("font_size") >= F.col("body_size") + 1.5, F.lit(False))
    shouting = (F.length("text") >= 4) & F.col("text").rlike(r"\p{L}") & (F.upper("text") == F.col("text")) & (F.size(F.split("text", " ")) <= 12)
    level = F.when(number != "", F.size(F.split(number, r"\."))).when(F.col("font_size").isNotNull() & F.col("body_size").isNotNull(), F.when(F.col("font_size") >= F.col("body_size") + 4, 1).otherwise(2)).otherwise(1)
    return rows.where((number != "") | large | shouting).select(key, "page_number", "text", level.alias("level_hint"), "font_size")


def contents_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages that have a line "contents" and at least two lines with leaders and a number."""
    lines = F.transform(F.split("text", r"\R"), normalize_space)
    titled = F.exists(lines, lambda x: F.lower(x).isin("contents", "table of contents"))
    return pages.where(titled & (F.size(F.filter(lines, lambda x: x.rlike(ENTRY))) >= 2)).select(key, "page_number")


def page_offset(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, printed_page_offset): the offset that most pages show, the larger of equals, where two or more do. Blocks have y0, page_height and position; the first that fits counts per page."""
    foot = blocks.where(F.col("y0") >= F.col("page_height") * 0.8).withColumn("printed", printed_page(F.regexp_extract("text", PAGE_NUMBER, 1)))
    first = foot.where("printed is not null").groupBy(key, "page_number").agg(F.min_by("printed", "position").alias("printed"))
    counts = first.groupBy(key, (F.col("page_number") - F.col("printed")).alias("offset")).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", "offset")).alias("best"))
    return best.where("best.n >= 2").select(key, F.col("best.offset").alias("printed_page_offset"))


def _words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s{2,}|[^\S ]", " ")), " ")


def _grams(c: Column) -> Column:
    """All runs of one to three characters of a word."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    return F.array_distinct(F.concat(at(1), at(2), at(3)))


def quote_keys(words: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote, word): the words of a corpus by which chunks with a quote are found; words: key, word, each once a chunk; quotes: quote.

    A word inside a quote is a whole word of every chunk that has the quote: of
    these the one in the fewest chunks is the key, and a quote with one that is
    nowhere is nowhere. A quote of one or two words has none. Its first word
    ends, and its last one begins, a word of the chunk (a single one is inside
    a word), so the longer of both is looked up in the corpus' distinct words by
    its first three characters as a gram, and every word that fits is a key.
    """
    named = quotes.select("quote", _words(F.col("quote")).alias("w"))
    inner = named.where("size(w) >= 3").select("quote", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    counts = words.join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rated = inner.join(counts, "word", "left").fillna(0, ["n"])
    best = rated.groupBy("quote").agg(F.min(F.struct("n", (-F.length("word")).alias("l"), "word")).alias("b"))
    keys = best.where("b.n > 0").select("quote", "b.word")
    short = named.where("size(w) < 3 and w[0] <> ''")
    if not short.limit(1).count():
        return keys
    first, last = F.col("w")[0], F.element_at("w", -1)
    part = F.when(F.length(first) >= F.length(last), first).otherwise(last)
    where = F.when(F.size("w") == 1, "in").when(F.length(first) >= F.length(last), "end").otherwise("start")
    short = short.select("quote", part.alias("part"), where.alias("place")).withColumn("gram", F.left("part", F.lit(3)))
    distinct = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    fits = F.when(F.col("place") == "in", F.col("word").contains(F.col("part"))).when(F.col("place") == "end", F.col("word").endswith(F.col("part"))).otherwise(F.col("word").startswith(F.col("part")))
    return keys.unionByName(distinct.join(short, "gram").where(fits).select("quote", "word").distinct())


def quotes_in(chunks: DataFrame, quotes: DataFrame, key: str, chunk_text: str = "text", quote: str = "quote") -> DataFrame:
    """Pairs where the chunk contains the quote, with ``offset``; ``key`` identifies a chunk.

    Both meet in equi-joins by the rarest word that they must share
    (``quote_keys``), and only such pairs are compared. A quote of blanks alone is
    found nowhere.
    """
    words = chunks.select(F.col(key), F.explode(F.array_distinct(_words(F.col(chunk_text)))).alias("word"))
    keys = quote_keys(words, quotes.select(F.col(quote).alias("quote")).where("quote is not null").distinct())
    met = words.join(keys, "word").select(key, "quote").distinct()
    both = met.withColumnRenamed("quote", "_quote").join(chunks, key).where(F.col(chunk_text).contains(F.col("_quote")))
    found = both.join(quotes, both["_quote"] == quotes[quote])
    return found.withColumn("offset", F.instr(F.col(chunk_text), F.col(quote)) - 1).drop("_quote")


def quotes_at(citations: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Citations with ``valid``: the named chunk exists, contains the quote and has the page."""
    held = chunks.select(key, F.col("text").alias("_text"), F.col("pages").alias("_pages"))
    found = citations.join(held, key, "left")
    inside = F.col("quote").isNull() | F.col("_text").contains(F.col("quote"))
    paged = F.col("page").isNull() | F.array_contains("_pages", F.col("page"))
    return found.withColumn("valid", F.coalesce(F.col("_text").isNotNull() & inside & paged, F.lit(False))).drop("_text", "_pages")


def distinct_citations(citations: DataFrame, order: str) -> DataFrame:
    """The first of equal (owner, chunk_id, page, quote); a null quote is one key."""
    rest = [c for c in citations.columns if c not in ("owner", "chunk_id", "page", "quote")]
    first = citations.groupBy("owner", "chunk_id", "page", "quote").agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("f"))
    return first.select("owner", "chunk_id", "page", "quote", "f.*")


def covered(citations: DataFrame, min_citations: int, min_pages: int) -> DataFrame:
    got = citations.groupBy("owner").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    return got.withColumn("covered", (F.col("n") >= min_citations) & (F.col("pages") >= min_pages))


def tiles(rows: DataFrame, position: str, size: int) -> DataFrame:
    """Adds ``tile``: groups of ``size`` following positions."""
    return rows.withColumn("tile", F.floor(F.col(position) / size).cast("long"))
