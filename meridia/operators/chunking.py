r"""Chunks of pages whose borders fall between sentences.

A page is cut into sentences by one expression, and its sentences are merged in
one ordered fold: a chunk takes sentences as long as they fit its budget of tokens, and
the next one begins with as many whole sentences of its end as fit the overlap. Everything
a fold needs is in its own state, so a page costs time in proportion to its
length, and chunks never leave their page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import parsed_chunk_id

#: words with a full stop that end no sentence
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "No", "Fig", "Eq", "Sec", "Vol", "pp", "p", "al", "cf", "Inc", "Ltd", "Corp", "Co", "e.g", "i.e", "approx")
_CLOSERS = "\"'”’»)\\]"
_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
#: after a mark and closing quotes, unless the word is an abbreviation or an initial
_TERMINAL = rf"(?<=[.!?…。！？][{_CLOSERS}]{{0,3}})(?<!(?<![^\s(\[])(?:{_SHORT}|\p{{Lu}})\.)"
_BLANK_LINE = r"(?<=\S)(?:[^\S\n]*+\n){2}\s*+"
#: words with the blanks between them, up to blanks at which a sentence (a clause) ends; borders are looked for at blanks alone
SENTENCE = rf"\S++(?:(?!{_TERMINAL}\s++(?!\p{{Ll}}|\z)|{_BLANK_LINE})\s++\S++)*+\s*+"
CLAUSE = r"\S++(?:(?<![,;:，；：])\s++\S++)*+\s*+"
WORD = r"\S++\s*+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Tokens of a text: its words."""
    return F.regexp_count(text, F.lit(r"\S++"))


def sentences(text: Column) -> Column:
    """array<string>: the sentences with the blanks after them; joined, they are the text without the blanks at its start.

    A sentence ends after ``. ! ? …`` and their wide forms, with closing quotes
    and brackets, if blanks and no small letter follow, but not after
    abbreviations and single initials; or at a blank line.
    """
    return _all(text, SENTENCE)


def units(text: Column, size: int, tokens: Callable[[Column], Column] = words) -> Column:
    """Sentences; in place of one over ``size`` tokens its clauses, and in place of such a clause its words."""

    def clauses(sentence: Column) -> Column:
        return F.flatten(F.transform(_all(sentence, CLAUSE), lambda c: F.when(tokens(c) <= size, F.array(c)).otherwise(_all(c, WORD))))

    return F.flatten(F.transform(sentences(text), lambda s: F.when(tokens(s) <= size, F.array(s)).otherwise(clauses(s))))


_PART = "struct<text:string,n:int,chars:int>"
_CHUNK = "struct<text:string,start:int>"


def merged(parts: Column, lead: Column, size: int, overlap: int) -> Column:
    """array<struct<text,start>>: parts (text, n, chars), in order, as chunks of at most ``size`` tokens; a part that alone is larger is a chunk.

    The state is the open chunk's parts, where it starts, and what is finished.
    A part that does not fit closes the chunk; the longest end of it that has at most
    ``overlap`` tokens, and leaves room for the part, opens the next.
    """
    total = lambda some, field: F.aggregate(some, F.lit(0), lambda a, x: a + x[field])
    joined = lambda some: F.array_join(F.transform(some, lambda x: x["text"]), "")

    def kept(held: Column, part: Column) -> Column:
        """How many parts of the chunk's end stay."""
        room = F.least(F.lit(overlap), F.lit(size) - part["n"])

        def step(a: Column, x: Column) -> Column:
            fits = a["open"] & (a["n"] + x["n"] <= room)
            return F.struct((a["n"] + F.when(fits, x["n"]).otherwise(0)).alias("n"), (a["k"] + F.when(fits, 1).otherwise(0)).alias("k"), fits.alias("open"))

        return F.aggregate(F.reverse(held), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open")), step, lambda a: a["k"])

    def closed(acc: Column) -> Column:
        return F.array_append(acc["done"], F.struct(joined(acc["held"]).alias("text"), acc["start"].alias("start")))

    def add(acc: Column, part: Column) -> Column:
        fits = (F.size(acc["held"]) == 0) | (acc["used"] + part["n"] <= size)
        more = F.struct(F.array_append(acc["held"], part).alias("held"), (acc["used"] + part["n"]).alias("used"), acc["start"].alias("start"), acc["done"].alias("done"))
        stays = F.slice(acc["held"], F.size(acc["held"]) - kept(acc["held"], part) + 1, kept(acc["held"], part))
        begin = acc["start"] + total(acc["held"], "chars") - total(stays, "chars")
        fresh = F.struct(F.array_append(stays, part).alias("held"), (total(stays, "n") + part["n"]).alias("used"), begin.alias("start"), closed(acc).alias("done"))
        return F.when(fits, more).otherwise(fresh)

    none = F.array().cast(f"array<{_PART}>"), F.array().cast(f"array<{_CHUNK}>")
    zero = F.struct(none[0].alias("held"), F.lit(0).alias("used"), lead.cast("int").alias("start"), none[1].alias("done"))
    return F.aggregate(parts, zero, add, lambda acc: F.when(F.size(acc["held"]) > 0, closed(acc)).otherwise(acc["done"]))


def chunks(pages: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id", tokens: Callable[[Column], Column] = words) -> DataFrame:
    """(key, page_number, position, text, start_char, end_char, chunk_id), and what the page has of block_boxes, screenshot_path and image_paths.

    Chunks have at most ``size`` tokens, of which at most ``overlap`` are
    repeated, in whole sentences (clauses or words of a sentence that is too long). Every
    chunk is a slice of its page without blanks at its ends, and carries the boxes of all
    blocks of its page (``blocks`` of ``parsed_pages``). Blank pages give none.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    carried = [c for c in ("screenshot_path", "image_paths") if c in pages.columns]
    boxes = [F.transform("blocks", lambda b: F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("block_boxes")] if "blocks" in pages.columns else []
    rows = pages.where(F.col("text").rlike(r"\S"))
    lead = F.length("text") - F.length(F.regexp_replace("text", r"\A\s++", ""))
    part = F.transform(units(F.col("text"), size, tokens), lambda u: F.struct(u.alias("text"), tokens(u).cast("int").alias("n"), F.length(u).alias("chars")))
    each = rows.select(key, "page_number", F.posexplode(merged(part, lead, size, overlap)).alias("position", "chunk"), *boxes, *carried)
    text = F.regexp_replace("chunk.text", r"\s++\z", "")
    each = each.select(key, "page_number", "position", text.alias("text"), F.col("chunk.start").alias("start_char"), *[c for c in each.columns if c in ("block_boxes", *carried)])
    each = each.withColumn("end_char", F.col("start_char") + F.length("text"))
    each = each.withColumn("chunk_id", parsed_chunk_id(F.col(key).cast("string"), F.col("page_number"), F.col("start_char"), F.col("end_char"), F.col("text")))
    first = [key, "page_number", "position", "text", "start_char", "end_char", "chunk_id"]
    return each.select(*first, *[c for c in each.columns if c not in first])


def _sql_words(size: int, source: str) -> str:
    """CTEs of DuckDB that end in unit: the parts of each page (doc_id, page_number) with their words, from word flags instead of one expression."""
    short = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
    closers = "\"''”’»)\\]"
    return f"""
pg AS ({source}),
w0 AS (SELECT doc_id, page_number, text, unnest(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+[ \\t\\n\\f\\r\\x0B]*')) AS word, generate_subscripts(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+[ \\t\\n\\f\\r\\x0B]*'), 1) AS i FROM pg),
w1 AS (SELECT *, regexp_extract(word, '^[^ \\t\\n\\f\\r\\x0B]+') AS bare, lead(word) OVER x AS following FROM w0 WINDOW x AS (PARTITION BY doc_id, page_number ORDER BY i)),
w2 AS (SELECT *, following IS NOT NULL AND (length(word) - length(replace(word, chr(10), '')) >= 2 OR (regexp_matches(bare, '[.!?…。！？][{closers}]{{0,3}}$') AND NOT regexp_matches(bare, '(^|[(\\[])({short}|\\p{{Lu}})[.]$') AND NOT regexp_matches(following, '^\\p{{Ll}}') AND length(word) > length(bare))) AS ends,
 following IS NULL OR regexp_matches(bare, '[,;:，；：]$') AS pauses FROM w1),
w3 AS (SELECT *, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER x - CASE WHEN ends THEN 1 ELSE 0 END AS sent FROM w2 WINDOW x AS (PARTITION BY doc_id, page_number ORDER BY i)),
w4 AS (SELECT *, sum(CASE WHEN pauses THEN 1 ELSE 0 END) OVER x - CASE WHEN pauses THEN 1 ELSE 0 END AS part, count(*) OVER (PARTITION BY doc_id, page_number, sent) AS sent_n FROM w3 WINDOW x AS (PARTITION BY doc_id, page_number, sent ORDER BY i)),
w5 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number, sent, part) AS part_n FROM w4),
unit AS (SELECT doc_id, page_number, min(i) AS first, count(*) AS n, string_agg(word, '' ORDER BY i) AS body FROM w5
 GROUP BY doc_id, page_number, sent, CASE WHEN sent_n > {size} THEN part ELSE -1 END, CASE WHEN sent_n > {size} AND part_n > {size} THEN i ELSE -1 END)"""


def chunk_sql(size: int, overlap: int, source: str) -> str:
    """The chunks of ``source`` (doc_id, page_number, text) in DuckDB: from chunk to chunk by recursion over prefix sums."""
    return f"""
WITH RECURSIVE {_sql_words(size, source)},
u AS (SELECT doc_id, page_number, list(n ORDER BY first) AS ns, list(body ORDER BY first) AS bodies FROM unit GROUP BY doc_id, page_number),
p AS (SELECT *, list_transform(range(len(ns) + 1), lambda k: coalesce(list_sum(ns[1:k]), 0)::BIGINT) AS cum FROM u),
c AS (SELECT doc_id, page_number, 0 AS position, 0::BIGINT AS a, greatest(len(list_filter(cum, lambda x: x <= {size})) - 1, 1)::BIGINT AS b FROM p
 UNION ALL SELECT doc_id, page_number, position + 1, a, greatest(len(list_filter(cum, lambda x: x <= cum[a + 1] + {size})) - 1, low + 1)::BIGINT FROM (
  SELECT c.doc_id, c.page_number, c.position, p.cum, c.b AS low, coalesce(list_min(list_filter(range(c.a + 1, c.b), lambda k: cum[c.b + 1] - cum[k + 1] <= {overlap} AND cum[c.b + 2] - cum[k + 1] <= {size})), c.b) AS a
  FROM c JOIN p USING (doc_id, page_number) WHERE c.b < len(p.ns))),
s AS (SELECT c.doc_id, c.page_number, c.position, (length(pg.text) - length(ltrim(pg.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) + coalesce(list_sum(list_transform(p.bodies[1:c.a], lambda x: length(x))), 0))::BIGINT AS start_char,
 rtrim(array_to_string(p.bodies[c.a + 1:c.b], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM c JOIN p USING (doc_id, page_number) JOIN pg USING (doc_id, page_number))
SELECT doc_id, page_number, position, start_char, start_char + length(text) AS end_char, sha256(doc_id || ':' || page_number || ':' || start_char || ':' || (start_char + length(text)) || ':' || text) AS chunk_id FROM s"""
