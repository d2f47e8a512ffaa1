r"""Secret scans through a trigram index. DataFrame functions only.

Every rule is a regular expression. From its syntax tree follows which three
letters in a row any match must hold, as a disjunction of conjunctions: a text
without all trigrams of one of them cannot match. ``build_index`` reads all texts
once and writes the posting lists of the trigrams that the rules ask for, one entry
for each distinct text and trigram; ``candidates`` intersects them; ``verify`` applies a rule's
expression to its candidates alone. A rule that has a match without any fixed
trigram, such as a run of hexadecimal digits, is applied to every text.

Copies of a text are indexed and verified once: texts are known by 160 bits of
hashes and length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from itertools import product

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python 3.10 and older
    import sre_constants as sre
    import sre_parse as parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and how long the match (or its ``group``) must be; shorter matches are dropped, without another try."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# fixed values: forms of keys
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
)

#: a class of at most so many letters is written out; an expression has at most so many alternatives before it is cut into gaps
CLASS, ALTERNATIVES = 6, 256
_GAP = None


def _letters(members) -> set[str] | None:
    """The letters of a character class in lower case, if they are few and ASCII."""
    out: set[int] = set()
    for op, arg in members:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < CLASS:
            out.update(range(arg[0], arg[1] + 1))
        else:
            return None
    low = {chr(c).lower() for c in out if c < 128}
    return low if len(out) <= 2 * CLASS and len(low) <= CLASS and all(c < 128 for c in out) else None


def _sequences(tree) -> list[tuple]:
    """The ways to match a syntax tree, each as letters with gaps between; a gap stands for any text."""
    ways: list[tuple] = [()]
    for op, arg in tree:
        if op is sre.LITERAL:
            own = [(chr(arg).lower(),)] if arg < 128 else [(_GAP,)]
        elif op is sre.IN:
            few = _letters(arg)
            own = [(c,) for c in sorted(few)] if few else [(_GAP,)]
        elif op is sre.SUBPATTERN:
            own = _sequences(arg[-1])
        elif op is sre.BRANCH:
            own = [w for branch in arg[1] for w in _sequences(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            once = _sequences(body)
            if high == 1:
                own = once if low else [(), *once]
            elif low == 0:
                own = [(_GAP,)]
            else:  # the first ``low`` copies stand side by side, as far as they are written out
                copies = min(low, 3)
                own = [sum(w, ()) + ((_GAP,) if high != copies else ()) for w in product(once, repeat=copies)] if len(once) ** copies <= ALTERNATIVES else [(_GAP,)]
        elif op is sre.ATOMIC_GROUP:
            own = _sequences(arg)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            own = [()]
        else:
            own = [(_GAP,)]
        if len(ways) * len(own) > ALTERNATIVES:
            own = [(_GAP,)]
        ways = list(dict.fromkeys(a + b for a in ways for b in own))
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams (of lower-case text), one of which every match holds in full; None if a match may hold none.

    Sets that hold another one are left out, since the other one decides.
    """
    sets = set()
    for way in _sequences(parser.parse(pattern)):
        runs = "".join("\n\n" if c is _GAP else c for c in way).split("\n\n") if way else [""]
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2) if "\n" not in run[i : i + 3])
        if not grams:
            return None
        sets.add(grams)
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def text_key(text: Column) -> Column:
    """160 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text)).alias("b"), F.octet_length(text).alias("n"))


def build_index(ws: Workspace, docs: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Postings (gram, key) of the trigrams that the queries name, for each distinct text; docs: key, text. In order of gram inside each file, so that a look-up skips what it does not need."""
    grams = sorted({g for sets in queries.values() for s in sets for g in s})
    if not grams:
        return ws.stage(docs.select(F.lit("").alias("gram"), "key").limit(0), "postings")
    low = docs.select("key", F.lower("text").alias("low"))
    held = low.select("key", F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams])).alias("grams")).where(F.size("grams") > 0)
    postings = held.select(F.explode("grams").alias("gram"), "key").groupBy("gram", "key").agg(F.lit(1).alias("one"))
    return ws.stage(postings.select("gram", "key").sortWithinPartitions("gram"), "postings")


def candidates(spark: SparkSession, postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): the rules that a text may match: those with a conjunction all of whose posting lists have the text."""
    terms = [(gram, f"{kind}:{i}", kind, len(s)) for kind, sets in queries.items() for i, s in enumerate(sets) for gram in s]
    asked = spark.createDataFrame(terms, "gram string, clause string, kind string, need long")
    met = postings.join(F.broadcast(asked), "gram")  # as many rows as the rules have trigrams
    whole = met.groupBy("key", "clause", "kind", "need").agg(F.count("*").alias("n")).where("n = need")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _long(least: int, value: Column) -> Column:
    return F.length(value) >= least


def _of(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def matches(texts: DataFrame, rules: tuple[Rule, ...], free: set[str]) -> DataFrame:
    """(key, kind, m): m has gaps, sizes and good of the matches of a rule in a text, as arrays: characters before each match, its length, and whether it is long enough.

    texts: key, text, kinds, of which kinds (null: none) names the rules to
    apply beside those in ``free``. One pass over the texts for all rules.
    """
    each = []
    for r in rules:
        asked = F.col("text").rlike(r.pattern)
        if r.kind not in free:
            asked = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & asked
        pattern = F.lit(r.pattern)
        found = F.struct(
            F.lit(r.kind).alias("kind"),
            F.transform(F.split("text", r.pattern, -1), lambda p: F.length(p)).alias("gaps"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), lambda v: F.length(v)).alias("sizes"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(r.group)), partial(_long, r.least)).alias("good"),
        )
        each.append(F.when(asked, found))
    return texts.select("key", F.explode(F.array_compact(F.array(*each))).alias("m")).select("key", "m.kind", F.struct("m.gaps", "m.sizes", "m.good").alias("m"))


def places(found: DataFrame) -> DataFrame:
    """(key, kind, start, end), in code points, of what ``matches`` gave; once for equal texts.

    The running position is a window over the matches of one text and kind, so
    many matches in one text take linear time.
    """
    once = found.groupBy("key", "kind").agg(F.any_value("m").alias("m"))
    each = once.select("key", "kind", F.posexplode(F.arrays_zip(F.slice("m.gaps", F.lit(1), F.size("m.sizes")).alias("gap"), F.col("m.sizes").alias("size"), F.col("m.good").alias("good"))).alias("pos", "x"))
    end = F.sum(F.col("x.gap") + F.col("x.size")).over(Window.partitionBy("key", "kind").orderBy("pos")).cast("int")
    return each.withColumn("end", end).where("x.good").select("key", "kind", (F.col("end") - F.col("x.size")).alias("start"), "end")


def scan(
    spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", broadcast_texts: int = 500_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans: array of (start, rule, kind, end), by start, then rule as listed.

    Offsets are code points, ``end`` exclusive; matches of one rule never overlap.
    A null text is the empty one and has no spans; ids may be null or repeat, and every row
    stays; whole texts are read, however long; an empty table gives no rows;
    other columns are ignored. Candidates up to ``broadcast_texts`` texts are sent to where the
    texts are read; more of them meet the texts in a shuffle.
    """
    if len({r.kind for r in rules}) != len(rules):
        raise ValueError("kinds must differ")
    ws = Workspace(spark, "secrets")
    derived = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {kind: sets for kind, sets in derived.items() if sets}
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    postings = build_index(ws, src, queries)
    named = ws.stage(candidates(spark, postings, queries), "candidates")
    few = named.count() <= broadcast_texts
    held = src.select("key", "text").join(F.broadcast(named) if few else named, "key", "left")
    every = matches(held, rules, {kind for kind, sets in derived.items() if sets is None})
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    at = places(every).select("key", F.struct("start", F.element_at(order, F.col("kind")).alias("rule"), "kind", "end").alias("span"))
    spans = ws.stage(at.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans")), "spans")
    out = src.select("doc_id", "key").join(spans, "key", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


BASE = ("assign", "access", "hex")


def digests(scanned: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans (of all kinds), as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    counts = [F.size(F.filter("spans", partial(_of, kind))).cast("long").alias(f"n_{kind}") for kind in base]
    return scanned.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
