r"""Personal data: base patterns, and information-theoretic sanitisation of what
else in the corpus gives the found entities away. DataFrame functions only.

Base kinds are found by pattern, leftmost and without overlap within a kind,
and then checked (address parts, Luhn, digit counts). The patterns are written
possessively and anchored to the start of a run (or to the end of the match
before, ``\G``), so that texts of any length are read in linear time.

Disclosure: every distinct text that mentions an entity c is an observation.
For a term t (four or more letters and digits in a row, anywhere in the text),
``PMI(c;t) = ln( P(t | texts with c) / P(t in a text) )`` is compared with
the information content ``IC(c) = ln( texts / texts with c )``. Their
quotient is the share of what c says that t already says. Pairs at or above
``generalise_at`` have t generalised, at or above ``remove_at`` removed, in the
documents that mention c. Counts cover all documents, equal texts once.

Credentials are protected as well, and have no form of their own: a key is any
long run of letters and digits. What gives one away is the company it keeps. For
a run t, the contexts are the texts in which it follows a word such as
``token`` or ``api key``, and the same quotient says how much more often that
is so than its share of all texts would have it; at or above ``remove_at`` the run
is taken for a secret wherever it stands. A run that stands elsewhere too, such
as a checksum or an id, stays.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

_L, _D = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind, pattern, what a text must hold for a match
BASE = (
    ("email", rf"(?:(?<![{_L}])|\G)[{_L}]++@[{_D}]++(?:\.[{_D}]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][0-9 -]{14,}[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
)
RUN = "A-Za-z0-9_+/=-"
SECRET = rf"(?<![{RUN}])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[{RUN}]{{16,}}+"
#: words that announce a credential, with what may stand between
CUE = r"(?:tokens?|secrets?|passw(?:or)?ds?|credentials?|bearer|(?:api|access|private|secret|auth)[_ -]?keys?)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?"
WORD = r"[\p{L}\p{M}\p{N}]{4,}"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: Column, kind: int) -> Column:
    """Matches of a pattern as structs (kind, start, end, value); code points, end exclusive.

    The running position is kept in a string, which grows in place, so the time
    is linear in the number of matches.
    """
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"), F.transform(values, lambda v: F.length(v)).alias("size"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(m["size"], F.lit(0))
        return F.struct(end.alias("at"), F.concat(acc["out"], begin.cast("string"), F.lit(","), end.cast("string"), F.lit(";")).alias("out"))

    places = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.split(acc["out"], ";"))
    found = F.filter(F.arrays_zip(places.alias("place"), values.alias("value")), lambda m: m["value"].isNotNull())
    at = lambda m, k: F.substring_index(m["place"], ",", k).cast("int")
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), at(m, 1).alias("start"), at(m, -1).alias("end"), m["value"].alias("value")))


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.length(digits).between(16, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def _span_holds(kind: str, span: Column) -> Column:
    return _holds(kind, span["value"])


def _is_kind(k: int, span: Column) -> Column:
    return span["kind"] == k


def base_spans(text: Column) -> Column:
    """All base spans of a text that is not null, by kind as in BASE, then start."""
    found = []
    for k, (kind, pattern, needs) in enumerate(BASE):
        spans = F.filter(spans_of(text, F.lit(pattern), k), partial(_span_holds, kind))
        found.append(F.when(text.contains("@") if needs == "@" else text.rlike(needs), spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == 0, F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9.]", ""))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def disclosing_terms(ws: Workspace, docs: DataFrame, found: DataFrame, generalise_at: float, remove_at: float, support: int) -> DataFrame:
    """(entity, term, removed) at or above the thresholds; docs: text; found: text, base, the documents with entities.

    A term that fewer than ``support`` texts share with an entity is no evidence.
    """
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)))
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.reverse("text")).alias("b"))  # of a text
    texts = docs.select(key.alias("key"), words(F.col("text")).alias("terms")).dropDuplicates(["key"])
    df = ws.stage(texts.select(F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs")), "df")
    n_docs = F.broadcast(df.where("term = ''").select(F.col("term_docs").cast("double").alias("n")))  # one row
    mention = found.select(key.alias("key"), F.array_distinct(F.transform("base", _entity)).alias("named"))  # the key before texts multiply
    mention = mention.select("key", F.explode("named").alias("entity")).groupBy("key", "entity").agg(F.lit(1).alias("x"))
    mention = ws.stage(mention.drop("x"), "mentions")
    contexts = ws.stage(mention.groupBy("entity").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support), "contexts")
    kept = mention.join(contexts.select("entity"), "entity").groupBy("key").agg(F.collect_list("entity").alias("entities"))
    held = found.select(key.alias("key"), "text").join(kept, "key").select("key", "entities", words(F.col("text")).alias("terms")).dropDuplicates(["key"])
    pairs = held.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    pairs = pairs.where(F.col("both") >= support).join(contexts, "entity").join(df, "term").crossJoin(n_docs)
    pmi = F.log((F.col("both") / F.col("contexts")) / (F.col("term_docs") / F.col("n")))
    ic = F.log(F.col("n") / F.col("contexts"))
    share = F.when(ic > 0, pmi / ic)
    return pairs.withColumn("share", share).where(F.col("share") >= generalise_at).select("entity", "term", (F.col("share") >= remove_at).alias("removed"))


def secret_runs(text: Column) -> Column:
    """array<struct<term,cued>> of the long runs of a text, in lower case, and whether one of them follows a cue."""
    low = F.lower(text)
    cued = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"{CUE}({SECRET})"), F.lit(1)))
    runs = F.array_distinct(F.regexp_extract_all(low, F.lit(SECRET), F.lit(0)))
    found = F.transform(runs, lambda t: F.struct(t.alias("term"), F.array_contains(cued, t).alias("cued")))
    mixed = text.rlike("[0-9][A-Za-z_+/=-]|[A-Za-z_+/=-][0-9]")
    return F.when(mixed & text.rlike(SECRET), found).otherwise(F.array().cast("array<struct<term:string,cued:boolean>>"))


def secret_terms(ws: Workspace, docs: DataFrame, found: DataFrame, remove_at: float) -> DataFrame:
    """(term) of the runs that are credentials; docs: text; found: text, runs."""
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.reverse("text")).alias("b"))  # of a text
    texts = found.where(F.size("runs") > 0).select(key.alias("key"), "runs").dropDuplicates(["key"])
    texts = ws.stage(texts.select("key", F.exists("runs", lambda r: r["cued"]).alias("any"), "runs"), "runs")
    contexts = texts.where("any").agg(F.count("*").cast("double").alias("contexts"))
    n_docs = docs.select(key.alias("key")).groupBy("key").agg(F.lit(1).alias("x")).agg(F.count("*").cast("double").alias("n"))
    one = F.broadcast(contexts.crossJoin(n_docs))  # one row
    runs = texts.select(F.explode("runs").alias("r")).groupBy("r.term").agg(F.count("*").alias("texts"), F.count_if("r.cued").alias("near")).where("near > 0")
    share = F.when(F.col("near") == F.col("texts"), 1.0).when(F.col("n") > F.col("contexts"), 1 + F.log(F.col("near") / F.col("texts")) / F.log(F.col("n") / F.col("contexts")))
    return runs.crossJoin(one).where(share >= remove_at).select("term")


def find(
    spark: SparkSession,
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    generalise_at: float = 0.9,
    remove_at: float = 0.98,
    support: int = 3,
) -> DataFrame:
    """Per document: doc_id, text (null where no span was found), base, terms, and the columns in ``keep``.

    base and terms are arrays of (kind, start, end, value), by kind and start;
    kinds 0 to 3 as in BASE, 4 for secrets, 5 for terms to generalise, 6 for
    terms to remove. Terms that overlap a base span are left to it. A null text
    counts as empty and has no spans; rows with a null id get base spans only;
    repeated rows are handled each, and rows of one id share their terms;
    texts of any length are read whole, in linear time; an empty table gives no
    rows.
    """
    ws = Workspace(spark, "pii")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    src = src.withColumn("base", base_spans(F.col("text"))).withColumn("runs", secret_runs(F.col("text")))
    all_rows = ws.stage(src.withColumn("text", F.when((F.size("base") > 0) | (F.size("runs") > 0), F.col("text"))), "base")
    found = all_rows.where("text is not null and doc_id is not null")
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    telling = ws.stage(disclosing_terms(ws, plain, found.where(F.size("base") > 0), generalise_at, remove_at, support), "terms")
    entities = found.select("doc_id", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    told = entities.join(telling, "entity").groupBy("doc_id", "term").agg(F.max("removed").alias("removed"))
    secrets = ws.stage(secret_terms(ws, plain, found, remove_at), "secrets")
    held = found.select("doc_id", F.explode(F.transform("runs", lambda r: r["term"])).alias("term")).join(secrets, "term").select("doc_id", "term").distinct()
    told = told.unionByName(held.withColumn("removed", F.lit(None).cast("boolean"))).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("removed").isNull(), F.col("term")))).alias("secret"),
        F.array_sort(F.collect_list(F.when(~F.col("removed"), F.col("term")))).alias("general"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("term")))).alias("gone"),
    )
    out = all_rows.join(told, "doc_id", "left")

    def occurrences(terms: str, kind: int, letters: str = r"\p{L}\p{M}\p{N}") -> Column:
        quoted = F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
        pattern = F.concat(F.lit(rf"(?iu)(?<![{letters}])(?:"), F.array_join(quoted, "|"), F.lit(rf")(?![{letters}])"))
        apart = F.filter(spans_of(F.col("text"), pattern, kind), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.when(F.size(terms) > 0, apart).otherwise(F.array().cast(SPAN))

    terms = F.concat(occurrences("secret", 4, RUN), occurrences("general", 5), occurrences("gone", 6))
    out = out.withColumn("terms", F.coalesce(terms, F.array().cast(SPAN)))
    return out.select("doc_id", "text", "base", "terms", *[F.col(f"keep_{c}").alias(c) for c in keep])


LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]", "[TERM]", "")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's label (removed terms by nothing); of overlapping spans the first, longest one stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    labels = F.array(*map(F.lit, LABELS))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        shown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(labels, s["kind"]))
        return F.struct(F.greatest(acc["at"], -s["neg"]).alias("at"), F.when(inside, acc["out"]).otherwise(shown).alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), **options) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; n_chars follows the new text. Null texts stay null."""
    rest = tuple(c for c in columns if c not in ("doc_id", "text", "n_chars"))
    src = docs.select(*columns).withColumn("whole", F.col("text"))
    sized = tuple(c for c in ("n_chars",) if c in columns)
    found = find(spark, src, keep=(*rest, *sized, "whole"), **options)
    out = found.withColumn("new", F.when(F.col("text").isNull(), F.col("whole")).otherwise(sanitised(F.col("text"), F.concat("base", "terms"))))
    cols = {"text": F.col("new")}
    if sized:
        cols["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("new").cast("long"))
    return out.select(*[cols.get(c, F.col(c)).alias(c) for c in columns])


NAMES = (*(kind for kind, _, _ in BASE), "secret", "term", "term")


def digests(found: DataFrame) -> DataFrame:
    """Counts and places: n_email to n_phone, base_sha256, spans, and n_secret, n_term and n_spans (all of them)."""
    names = F.array(*map(F.lit, NAMES))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", partial(_is_kind, k))).cast("long").alias(f"n_{kind}") for k, (kind, _, _) in enumerate(BASE)]
    ordered = F.array_sort(F.transform("terms", lambda s: F.struct((s["kind"] > 4).alias("term"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    n_secret = F.size(F.filter("terms", partial(_is_kind, 4))).cast("long")
    spans = F.concat_ws(",", F.when(F.size("base") > 0, text(F.col("base"))), F.when(F.size("terms") > 0, text(ordered)))
    n_terms, n_base = F.size("terms").cast("long"), F.size("base").cast("long")
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), n_secret.alias("n_secret"), (n_terms - n_secret).alias("n_term"), (n_base + n_terms).alias("n_spans"))
