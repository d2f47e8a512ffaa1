"""HTML as text, by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.batches import bounded, released

BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
SKIPPED = frozenset("script style noscript template head svg".split())
BOILERPLATE = frozenset("nav header footer aside form".split())


class _Text(HTMLParser):
    def __init__(self, strip_boilerplate: bool):
        super().__init__(convert_charrefs=True)
        self.skipped = SKIPPED | (BOILERPLATE if strip_boilerplate else frozenset())
        self.depth, self.out, self.link = 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.depth += 1
        elif not self.depth:
            if tag in BLOCKS:
                self.out.append("\n- " if tag == "li" else "\n")
            if re.fullmatch("h[1-6]", tag):
                self.out.append("#" * int(tag[1]) + " ")

    def handle_startendtag(self, tag, attrs):
        if not self.depth and tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCKS and not self.depth:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(re.sub(r"\s+", " ", data))


def to_text(html: str | None, strip_boilerplate: bool = True) -> str:
    """Visible text, one line per block, headings and list items marked; '' for nothing."""
    if not html or not html.strip():
        return ""
    parser = _Text(strip_boilerplate)
    parser.feed(html)
    parser.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def _whole(s: pd.Series) -> pd.Series:
    out = s.map(lambda x: to_text(x, False), na_action="ignore")
    released()
    return out


@F.pandas_udf(StringType())
def _main(s: pd.Series) -> pd.Series:
    out = s.map(to_text, na_action="ignore")
    released()
    return out


def html_text(c: Column, strip_boilerplate: bool = True) -> Column:
    """``to_text`` in batches that are bounded in bytes, since pages may be large."""
    bounded()
    return (_main if strip_boilerplate else _whole)(c)


def html_or_text(c: Column) -> Column:
    """Text without ``<`` or ``>`` as it is; of HTML the text, or the original where there is none."""
    marked = c.contains("<") & c.contains(">")
    return F.when(F.trim(c) == "", "").when(~marked, F.trim(c)).otherwise(F.coalesce(F.nullif(html_text(F.when(marked, c)), F.lit("")), F.trim(c)))
