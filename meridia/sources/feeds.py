"""RSS and Atom feeds and listing pages as rows, parsed in the workers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.batches import bounded, released
from ..plans.schemas import FEED_ITEM, LISTING_ROW

#: bytes of a document that are parsed at once, and characters of items that are sent on together
PART = 1 << 18


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _text(node, *names: str) -> str | None:
    for name in names:
        for child in node:
            if _name(child.tag) == name and (t := "".join(child.itertext()).strip()):
                return t
    return None


def _time(value: str | None) -> datetime | None:
    if not value:
        return None
    for parse in (parsedate_to_datetime, lambda v: datetime.fromisoformat(v.replace("Z", "+00:00"))):
        try:
            t = parse(value)
            return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
        except (TypeError, ValueError):
            continue
    return None


#: per format: the element that holds the items, the item, and per column the elements to look in, in turn
FORMATS = {
    "rss": ("channel", "item", {"title": ("title",), "id": ("guid",), "published_at": ("pubdate", "date", "published"), "summary_html": ("description", "summary"), "content_html": ("encoded", "content")}),
    "feed": (None, "entry", {"title": ("title",), "id": ("id",), "published_at": ("published", "updated"), "summary_html": ("summary",), "content_html": ("content",)}),
}


def _link(item) -> str | None:
    """An address as an element's text, or as the attribute of the alternate link, or else of the first."""
    if plain := _text(item, "link"):
        return plain
    links = [(c.get("rel", "alternate") != "alternate", n, c.get("href")) for n, c in enumerate(item) if _name(c.tag) == "link" and c.get("href")]
    return min(links)[2] if links else None


def _children(xml: bytes | str) -> Iterator[tuple]:
    """(root, place, element) in the order of the text: children of the root ("root") and of the first element that holds items ("holder"), each complete and dropped before the next, then the root ("end")."""
    parser, path, held = ElementTree.XMLPullParser(("start", "end")), [], 0

    def events():
        for at in range(0, len(xml), PART):
            parser.feed(xml[at : at + PART])
            yield from parser.read_events()
        parser.close()
        yield from parser.read_events()

    for event, node in events():
        if event == "start":
            path.append(node)
            continue
        path.pop()
        if not path:
            yield node, "end", node
            continue
        holder = FORMATS.get(_name(path[0].tag), (None,))[0]
        inner = len(path) == 2 and holder is not None and _name(path[1].tag) == holder
        if inner and not held:
            yield path[0], "holder", node
        elif len(path) == 1:
            yield path[0], "root", node
            held += _name(node.tag) == holder
        if inner or len(path) == 1:
            path[-1].remove(node)


def feed_rows(xml: bytes | str, feed_url: str) -> Iterator[dict]:
    """Items of an RSS or Atom document one after another, namespaces ignored; ValueError for anything else, before the first item.

    The document is read twice, the first time for its kind, its title and its
    errors, so that no more than a part of it is held as elements.
    """
    xml = xml or ""
    titles, kind, place = {}, "", "root"
    try:
        for root, where, node in _children(xml):
            kind = _name(root.tag)
            if where == "root" and _name(node.tag) == FORMATS.get(kind, (None,))[0]:
                place = "holder"
            if where != "end" and where not in titles and _name(node.tag) == "title" and (title := "".join(node.itertext()).strip()):
                titles[where] = title
    except ElementTree.ParseError as exc:
        raise ValueError(f"{feed_url} is no XML: {exc}") from exc
    if kind not in FORMATS:
        raise ValueError(f"{feed_url} is neither RSS nor Atom but {kind!r}")
    _, item, fields = FORMATS[kind]
    for _, where, node in _children(xml):
        if where == place and _name(node.tag) == item:
            row = {"feed_url": feed_url, "feed_title": titles.get(place), "url": _link(node)} | {column: _text(node, *names) for column, names in fields.items()}
            yield row | {"id": row["id"] or row["url"], "published_at": _time(row["published_at"]), "raw": {_name(c.tag): "".join(c.itertext()).strip() for c in node}}


def parse_feed(xml: bytes | str, feed_url: str) -> list[dict]:
    """All of ``feed_rows``."""
    return list(feed_rows(xml, feed_url))


def read_feeds(fetched: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Feed items of fetched documents. A document that is no feed is one row, with ``error`` saying why; others go on.

    A task holds the text of one large document, and a bounded part of its items.
    """

    def framed(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=schema.names)
        return out.astype(object).where(out.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for u, b in zip(pdf[url], pdf[body]):
                try:
                    for row in feed_rows(b, u):
                        rows.append(row)
                        size += sum(map(len, row["raw"].values()))
                        if len(rows) >= 1000 or size >= PART:
                            yield framed(rows)
                            rows, size = [], 0
                except ValueError as exc:
                    rows.append({"feed_url": u, "error": str(exc)})
            if rows:
                yield framed(rows)
                rows, size = [], 0
            released()

    bounded(fetched.sparkSession)
    schema = T.StructType([*FEED_ITEM.fields, T.StructField("error", T.StringType())])
    return fetched.select(url, body).mapInPandas(run, schema)


# fixed values: marks of a listing page's rows, links and date
ROW_CLASSES, LINK_CLASS, DATE_INPUT = frozenset({"row", "newsCards"}), "newsreleaseconsolidatelink", "date"


class _Listing(HTMLParser):
    """Rows are ``div`` elements of both row classes, with a link, a heading and, in the heading, a small time."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.page_date, self.rows = html, None, []
        self.row, self.depth, self.heading, self.small = None, 0, False, False
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        if self.row is None and tag == "div" and ROW_CLASSES <= classes:
            self.row, self.depth, self.heading, self.small = {"href": None, "title": "", "timestamp_text": "", "raw_html": self._at()}, 0, False, False
        if self.row is None:
            if tag == "input" and a.get("id") == DATE_INPUT:
                self.page_date = a.get("value")
            return
        self.depth += tag == "div"
        if tag == "a" and LINK_CLASS in classes:
            self.row["href"] = self.row["href"] or a.get("href")
        self.heading |= tag == "h3"
        self.small |= tag == "small" and self.heading

    def handle_startendtag(self, tag, attrs):
        if self.row is None:
            self.handle_starttag(tag, attrs) if tag == "input" else None

    def handle_endtag(self, tag):
        if self.row is None:
            return
        self.heading &= tag != "h3"
        self.small &= tag not in ("h3", "small")
        self.depth -= tag == "div"
        if self.depth == 0:
            end = self.html.index(">", self._at()) + 1
            self.rows.append({k: self.html[v:end] if k == "raw_html" else " ".join(v.split()) if v else v for k, v in self.row.items()})
            self.row = None

    def handle_data(self, data):
        if self.row is not None and self.heading:
            self.row["timestamp_text" if self.small else "title"] += data


def parse_listing(html: str) -> tuple[str | None, list[dict]]:
    """(the page's date as written, its rows)."""
    page = _Listing(html)
    return page.page_date, page.rows


def read_listings(pages: DataFrame) -> DataFrame:
    """Rows of listing pages (page_number, html, fallback_date); the page's own date is month/day/year."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for number, html, fallback in zip(pdf["page_number"], pdf["html"], pdf["fallback_date"]):
                date, rows = parse_listing(html or "")
                day = datetime.strptime(date, "%m/%d/%Y").date() if date else fallback
                out += [{"page_number": number, "row_number": i, "page_date": day, **r} for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=LISTING_ROW.names)
            released()

    bounded(pages.sparkSession)
    return pages.select("page_number", "html", "fallback_date").mapInPandas(run, LISTING_ROW)
