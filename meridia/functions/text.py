r"""Text functions as Column expressions.

White space is the Unicode set that a text editor would strip, because Spark's
``trim`` only knows the blank and Java's ``\s`` only ASCII. The one thing Spark
cannot do, NFKC normalisation, is an Arrow function that sees nothing of rows
that are ASCII. No lambda refers to an expression outside itself: Spark would
evaluate it again for every element.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .batches import bounded

BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _ranges(chars: str) -> str:
    """Characters as ranges of a pattern's class."""
    codes = [ord(c) for c in chars]
    firsts = [c for c in codes if c - 1 not in codes]
    lasts = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts))


WHITE, RARE = _ranges(BLANKS), _ranges("".join(c for c in BLANKS if c not in " \n"))

# fixed values: characters replaced after NFKC, tracking parameters, exchanges, patterns of hints, links, marks and protected addresses
PLAIN_FROM, PLAIN_TO = "‘’“”–— ", "''\"\"-- "
TRACKING = ("fbclid", "feedref", "gclid", "mc_cid", "mc_eid", "spm")
EXCHANGES = {
    "NASDAQ": "NASDAQ", "NYSE": "NYSE", "NYSE AMERICAN": "NYSE American", "NYSE MKT": "NYSE American", "NYSE ARCA": "NYSE Arca",
    "AMEX": "NYSE American", "OTCQX": "OTCQX", "OTCQB": "OTCQB", "OTC": "OTC", "CBOE": "CBOE",
}
TICKER = r"(?iuU)(?:\(|\b)(NASDAQ|NYSE(?:\s+American|\s+MKT|\s+Arca)?|AMEX|OTCQX|OTCQB|OTC|CBOE)\s*:\s*([A-Z][A-Z0-9.-]{0,9})(?:\)|\b)"
LISTED = "(?i)NASDAQ|NYSE|AMEX|OTC|CBOE"
LINK = r"\[([^\]\n]+)\]\([^)\n]*\)"
EMPHASIS = r"(?iu)(?<!\*)\*{1,2}([A-Z][A-Z0-9.-]{0,9})\*{1,2}(?!\*)"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PROTECTED = r"\[\[email protected]\]\(/cdn-cgi/l/email-protection#[^)]+\)"
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:", "DOI:")
SUFFIX_TYPES = {
    ".pdf": "application/pdf", ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml", ".md": "text/markdown",
    ".markdown": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".xml": "application/xml",
}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_space(c: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]{{2,}}|[{RARE}\\n]", " "))


def collapse_whitespace(c: Column) -> Column:
    """Runs of horizontal white space to a blank, blank gaps to one empty line, then line ends and both ends stripped. Apply once: it is not idempotent."""
    c = F.regexp_replace(c, r"[ \t\f\x0b]{2,}|[\t\f\x0b]", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    # by now only rare white space can stand before a line end beside a blank
    ends = F.when(c.rlike(f"[{RARE}]"), F.regexp_replace(c, rf"[{RARE} ]++(?=\n)", "")).otherwise(F.replace(c, F.lit(" \n"), F.lit("\n")))
    return strip(ends)


def dedupe_lines(c: Column) -> Column:
    """Drops a line that is not blank and equals, but for white space around it, the line before."""
    lines = F.split(c, "\n", -1)
    keys = F.transform(lines, strip)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(keys, F.lit(1), F.size(keys) - 1))
    kept = F.filter(F.arrays_zip(lines.alias("line"), keys.alias("key"), before.alias("before")), lambda x: (x["key"] == "") | ~x["key"].eqNullSafe(x["before"]))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_unicode(c: Column) -> Column:
    """NFKC, plain quotes and dashes, no control characters but tab, line feed and carriage return."""
    bounded()
    ascii_only = c.rlike(r"^[\x00-\x7f]*\z")
    folded = F.when(ascii_only, c).otherwise(F.translate(_nfkc(F.when(~ascii_only, c)), PLAIN_FROM, PLAIN_TO))
    return F.regexp_replace(folded, CONTROLS, "")


def with_news_text(df: DataFrame, column: str) -> DataFrame:
    """The column cleaned for news: normalised, protected addresses shown, repeated lines dropped, white space collapsed.

    Works on a table because the Arrow function must be done before its result
    enters an expression with a lambda.
    """
    df = df.withColumn(column, normalize_unicode(F.col(column)))
    shown = F.regexp_replace(column, PROTECTED, "[email protected]")
    return df.withColumn(column, collapse_whitespace(dedupe_lines(shown)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, the rest sorted, no fragment, no trailing slash."""
    url = strip(c)
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    scheme = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):"))
    host = F.lower(part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"))
    path = part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, r"/+\z", ""))
    query = part(r"^[^?#]*\?([^#]*)")
    plain = lambda x: F.coalesce(F.call_function("try_url_decode", x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(
        F.filter(F.split(query, "&", -1), lambda x: x != ""),
        lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("k"), plain(F.regexp_extract(x, r"(?s)^[^=]*=(.*)", 1)).alias("v")),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when((host != "") | url.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), F.concat(F.lit("//"), host)).otherwise(""))
    return F.concat(head, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def ticker_hints(c: Column) -> Column:
    """array<struct<symbol,exchange,raw>> of exchange-qualified symbols, the first of each kept; links and emphasis are read through."""
    scan = F.regexp_replace(F.regexp_replace(c, LINK, "$1"), EMPHASIS, "$1")
    group = lambda k: F.regexp_extract_all(scan, F.lit(TICKER), F.lit(k))
    names = F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv])
    found = F.transform(
        F.arrays_zip(group(1).alias("exchange"), group(2).alias("symbol"), group(0).alias("raw")),
        lambda m: F.struct(
            F.upper(m["symbol"]).alias("symbol"),
            F.coalesce(F.try_element_at(names, normalize_space(F.upper(m["exchange"]))), F.upper(m["exchange"])).alias("exchange"),
            F.trim(m["raw"]).alias("raw"),
        ),
    )
    none = F.array().cast("array<struct<symbol:string,exchange:string,raw:string>>")
    same = lambda m: lambda k: (k["symbol"] == m["symbol"]) & (k["exchange"] == m["exchange"])
    first = F.aggregate(found, none, lambda kept, m: F.when(F.exists(kept, same(m)), kept).otherwise(F.concat(kept, F.array(m))))
    return F.when(c.rlike(LISTED), first).when(c.isNotNull(), none)


def append_tags(tags: Column, new: Column) -> Column:
    """Tags with those of ``new`` that are missing, in order; repeats that are there stay."""
    return F.concat(tags, F.filter(F.array_distinct(new), lambda x: ~F.array_contains(tags, x)))


def json_fence_stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip(c), r"(?s)^```(?:json)?[^\S\n]*\n?(.*?)\n?```\z", "$1"))


def content_type(path: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in SUFFIX_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(types, F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))), F.lit("application/octet-stream"))


def arxiv_id(c: Column) -> Column:
    """A modern identifier first, else one of the old kind; null where there is none."""
    bare = F.regexp_replace(strip(c), "^(?:arXiv:|arxiv:)+", "")
    modern = F.regexp_extract(bare, r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    old = F.regexp_extract(bare, r"([a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)", 1)
    return F.coalesce(F.nullif(modern, F.lit("")), F.nullif(old, F.lit("")))


def doi(c: Column) -> Column:
    """The identifier without its prefix; null where it has not the form of one."""
    bare = F.regexp_replace(strip(c), "^(?:" + "|".join(DOI_PREFIXES).replace(".", r"\.") + ")", "")
    return F.when(bare.rlike(r"(?i)^10\.\d{4,9}/\S+\z"), bare)


def authors(people: Column) -> Column:
    """Names from array<struct<given,family>>: both, either, none skipped."""
    return F.filter(F.transform(people, lambda p: F.trim(F.concat_ws(" ", p["given"], p["family"]))), lambda x: x != "")


def printed_page(c: Column) -> Column:
    """Number of a printed page, arabic or roman (subtractive, not validated); null for none or nought."""
    value = F.lower(c)
    digit = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    fold = F.aggregate(
        F.reverse(F.filter(F.split(value, ""), lambda x: x != "")),
        zero,
        lambda a, x: F.struct(
            (a["sum"] + F.when(F.element_at(digit, x) < a["top"], -F.element_at(digit, x)).otherwise(F.element_at(digit, x))).alias("sum"),
            F.greatest(a["top"], F.element_at(digit, x)).alias("top"),
        ),
        lambda a: a["sum"],
    )
    number = F.when(value.rlike(r"^\d{1,9}\z"), value.cast("int")).when(value.rlike(r"^[ivxlcdm]+\z"), fold)
    return F.nullif(number, F.lit(0))
