"""Seams for models, with deterministic offline stand-ins.

Embedding, drafting, summarising and selecting are callables that a caller
injects; those here need no network and give the same result on every run.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from ..functions.batches import bounded, released
from .ancestry import staged
from .documents import finding_violations
from .integrity import require_none
from .trees import budgeted

FLAT_SUMMARY = "Source pages retained in canonical storage."  # fixed value
Draft = list[dict]  # nodes: title, summary, start_page, end_page, children


def hashed_embedding(text: str | None, dimensions: int = 64) -> list[float]:
    """Signed hashed words; never a zero vector."""
    v = [0.0] * dimensions
    for word in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(word.encode())
        v[h % dimensions] += 1.0 if h >> 16 & 1 else -1.0
    if not any(v):
        v[0] = 1.0
    return v


def embed(texts: Column, provider: Callable[[str], list[float]] = hashed_embedding) -> Column:
    """A column of vectors, in Arrow batches that are bounded in bytes, since texts may be long."""
    bounded()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        out = s.map(lambda t: None if t is None else provider(t))
        released()
        return out

    return run(texts)


def embed_stale(current: DataFrame, stored: DataFrame, key: str, compared: list[str], text: str, provider: Callable = hashed_embedding) -> DataFrame:
    """Rows of ``current`` with vectors: those of ``stored`` where nothing changed, new ones elsewhere."""
    from .search import stale

    fresh = stale(current, stored, key, compared)
    kept = current.join(fresh.select(key), key, "left_anti").join(stored.select(key, "embedding"), key)
    return kept.unionByName(fresh.withColumn("embedding", embed(F.col(text), provider)).select(*kept.columns))


def outline_draft(headings: list[tuple[int, str, int]], pages: int) -> Draft:
    """A one-level draft from (page, title, level) of headings of the first level; without any, one node for all pages."""
    tops = [(p, t) for p, t, level in headings if level == 1] or [(1, "Document")]
    ends = [max(p, q - 1) for (p, _), (q, _) in zip(tops, tops[1:])] + [pages]
    return [{"title": t, "summary": t, "start_page": p, "end_page": e, "children": []} for (p, t), e in zip(tops, ends)]


def build_tree(draft: Draft, page_texts: dict[int, str], title: str, max_depth: int = 6, max_nodes: int = 200) -> list[dict]:
    """Nodes of a draft, by dotted paths from 0; leaves hold their pages' text, inner nodes none.

    The root is the first level and the first node. ValueError for pages
    outside the source, and too many nodes or levels.
    """
    every = sorted(page_texts)
    root = {"title": title, "summary": title, "pages": every, "children": draft}
    out: list[dict] = []
    todo = [(root, "0", None, 0, 1)]
    while todo:  # in reading order
        node, path, parent, position, depth = todo.pop()
        if depth > max_depth:
            raise ValueError(f"the draft has more than {max_depth} levels")
        if len(out) >= max_nodes:
            raise ValueError(f"the draft has more than {max_nodes} nodes")
        pages = node["pages"] if "pages" in node else list(range(node["start_page"], node["end_page"] + 1))
        if not pages or not set(pages) <= set(every):
            raise ValueError(f"pages {node.get('start_page')} to {node.get('end_page')} are not in the source")
        kids = node.get("children") or []
        content = None if kids else "\n\n".join(page_texts[p] for p in pages)
        out.append({"path": path, "parent": parent, "position": position, "title": node["title"], "summary": node["summary"], "pages": pages, "content": content, "children": [f"{path}.{i}" for i in range(len(kids))]})
        todo += [(kid, f"{path}.{i}", path, i, depth + 1) for i, kid in reversed(list(enumerate(kids)))]
    return out


def flat_draft(pages: int, max_nodes: int) -> Draft:
    """The fallback: groups of following pages of equal size, at most max_nodes - 1."""
    leaves = min(pages, max(0, max_nodes - 1))
    size = -(-pages // leaves) if leaves else 0
    groups = [(a, min(pages, a + size - 1)) for a in range(1, pages + 1, size)] if size else []
    return [{"title": f"Page {a}" if a == b else f"Pages {a}-{b}", "summary": FLAT_SUMMARY, "start_page": a, "end_page": b, "children": []} for a, b in groups]


NODE_SCHEMA = "doc_id string, node_id string, parent_id string, position int, title string, summary string, pages array<int>, content string, children_ids array<string>, error string"


def build_trees(documents: DataFrame, draft: Callable[[list, int], Draft] = outline_draft, **limits) -> DataFrame:
    """Node rows of documents (doc_id, title, page_texts map<int,string>, headings array<struct>), a row with ``error`` where a draft fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d in pdf.to_dict("records"):
                texts = dict(d["page_texts"])
                heads = [(h["page"], h["title"], h["level"]) for h in d["headings"]]
                try:
                    for n in build_tree(draft(heads, len(texts)), texts, d["title"], **limits):
                        rows.append((d["doc_id"], n["path"], n["parent"], n["position"], n["title"], n["summary"], n["pages"], n["content"], n["children"], None))
                except ValueError as exc:
                    rows.append((d["doc_id"], None, None, None, None, None, None, None, None, str(exc)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in NODE_SCHEMA.split(", ")]).astype({"position": "Int32"})

    return documents.select("doc_id", "title", "page_texts", "headings").mapInPandas(run, NODE_SCHEMA)


RESEARCH = "struct<summary:string,findings:array<struct<chunk_index:int,page:int,claim:string,quote:string>>>"


def first_sentences(chunks: list[dict]) -> dict:
    """A report of following chunks (chunk_index, pages, text) without a model: what each says first, quoted."""
    found = []
    for c in chunks:
        quote = re.split(r"(?<=[.!?])\s", c["text"].strip(), maxsplit=1)[0][:200]
        if quote and len(c["pages"]):
            found.append({"chunk_index": c["chunk_index"], "page": int(c["pages"][0]), "claim": quote, "quote": quote})
    return {"summary": " ".join(f["claim"] for f in found), "findings": found}


def join_reports(summaries: list[str], budget: int) -> str:
    """One text of several without a model: each in order, cut to its share of the budget; what short ones leave goes to the others."""
    left, out = budget - (len(summaries) - 1), [""] * len(summaries)
    for n, i in enumerate(sorted(range(len(summaries)), key=lambda i: len(summaries[i]))):
        out[i] = summaries[i][: max(0, left // (len(summaries) - n))]
        left -= len(out[i])
    return "\n".join(x for x in out if x)


def reports(chunks: DataFrame, group: int = 8, research: Callable[[list[dict]], dict] = first_sentences, key: str = "doc_id") -> DataFrame:
    """(key, group, start, count, report): what ``research`` finds in each group of following chunks. chunks: key, position (from 0), chunk_id, pages, text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("chunk_index"), "pages", "text")))
    groups = chunks.groupBy(key, F.floor(F.col("position") / group).cast("long").alias("group")).agg(rows.alias("c"))

    @F.pandas_udf(RESEARCH)
    def study(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([research([dict(c) for c in cs]) for cs in s], columns=["summary", "findings"])

    return groups.select(key, "group", F.col("c")[0]["chunk_index"].alias("start"), F.size("c").alias("count"), study("c").alias("report"))


def summarise(
    chunks: DataFrame, group: int = 8, research: Callable[[list[dict]], dict] = first_sentences, reduce: Callable[[list[str], int], str] = join_reports,
    fan_in: int = 8, budget: int = 4000, key: str = "doc_id",
) -> DataFrame:
    """(key, summary, findings): each group of following chunks is studied, findings are validated, and summaries are reduced level by level.

    A finding must be of its group, on a page of its chunk, and quote its text;
    else nothing is reduced and StaleStoreError names the first. Up to ``fan_in`` reports
    become one of at most ``budget`` characters, and so on until a document
    has one, so that no step reads more than ``fan_in * budget`` characters, whatever the number of chunks.
    """
    found = staged(reports(chunks, group, research, key), "reports")
    flat = found.select(key, "group", F.posexplode("report.findings").alias("nth", "f")).select(key, "group", "nth", "f.*")
    held = chunks.select(key, F.col("position").alias("chunk_index"), "pages", "text")
    broken = finding_violations(found.select(key, "group", "start", "count"), flat, held, key)
    require_none(broken.select("rule", F.col(key).cast("string").alias("key"), F.col("chunk_index").cast("string").alias("detail")))

    @F.pandas_udf(StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda texts: reduce([t for t in texts], budget)[:budget])

    level = found.select(key, F.col("group").alias("n"), F.substring("report.summary", 1, budget).alias("summary"))
    most = found.agg(F.max("group")).first()[0]
    while most:
        up = level.groupBy(key, F.floor(F.col("n") / fan_in).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "summary"))).alias("s"))
        level = staged(up.select(key, "n", fold(F.transform("s", lambda x: x["summary"])).alias("summary")), "level")
        most //= fan_in
    ids = chunks.select(key, F.col("position").cast("int").alias("chunk_index"), "chunk_id")
    cited = flat.join(ids, [key, "chunk_index"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "nth", "chunk_id", "page", "claim", "quote"))).alias("findings"))
    return level.select(key, "summary").join(cited, key, "left")


class RetrievalError(RuntimeError):
    """A selection that exceeds its bounds."""


def lexical_selector(structure: str, question: str, seeds: list[int] = (), limit: int = 3) -> list[int]:
    """Numbers of the nodes of a serialised structure that share most words with the question; of equals, seeds first."""
    asked = set(re.findall(r"\w+", question.lower()))
    scored = [(-len(asked & set(re.findall(r"\w+", f"{n.get('title', '')} {n.get('summary', '')}".lower()))), n["n"] not in seeds, n["n"]) for n in json.loads(structure)]
    return [n for s, _, n in sorted(scored)[:limit] if s < 0]


def retrieve(
    nodes: DataFrame, question: str, selector: Callable[[str, str, list[int]], list[int]] = lexical_selector, token_budget: int = 2000, key: str = "tree_id", order: str = "n",
    seeds: DataFrame | None = None, max_evidence: int = 16,
) -> DataFrame:
    """Nodes that the selector picks from each tree's bounded structure, in its order (``nth``), each once.

    ``seeds`` (key, order) are hints for the selector and must be nodes. A blank
    question, an unknown seed and an unknown selected node are ValueErrors; more
    than ``max_evidence`` nodes of a tree are a RetrievalError.
    """
    if not question.strip():
        raise ValueError("a question needs text")
    if max_evidence < 1:
        raise ValueError("max_evidence must be at least 1")
    shown = budgeted(nodes, token_budget, key, order, "title", "summary").select(key, "serialised")
    kind = dict(nodes.dtypes)
    if seeds is not None:
        if lost := seeds.join(nodes, [key, order], "left_anti").limit(1).collect():
            raise ValueError(f"unknown seed {lost[0].asDict()}")
        shown = shown.join(seeds.groupBy(key).agg(F.array_sort(F.collect_set(order)).alias("seeds")), key, "left")
    else:
        shown = shown.withColumn("seeds", F.lit(None).cast(f"array<{kind[order]}>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text, hints in zip(pdf[key], pdf["serialised"], pdf["seeds"]):
                picked = selector(text.replace(f'"{order}":', '"n":'), question.strip(), [] if hints is None else list(hints))
                rows += [(k, n, i) for i, n in enumerate(dict.fromkeys(picked))]
            yield pd.DataFrame(rows, columns=[key, order, "nth"])

    picked = staged(shown.mapInPandas(run, f"{key} {kind[key]}, {order} {kind[order]}, nth int"), "picked")
    if lost := picked.join(nodes, [key, order], "left_anti").limit(1).collect():
        raise ValueError(f"selected an unknown node {lost[0].asDict()}")
    if many := picked.groupBy(key).count().where(F.col("count") > max_evidence).limit(1).collect():
        raise RetrievalError(f"selected {many[0]['count']} nodes of {many[0][key]}, at most {max_evidence} are allowed")
    return nodes.join(picked, [key, order])


def run_structured(run: Callable[[bool], object], validate: Callable[[object], object], rejected: Callable[[Exception], bool]) -> object:
    """The validated answer of a model, asked for its strict form first and, where a provider rejects that form, for a JSON object.

    ``run(False)`` asks strictly, ``run(True)`` for an object as text, which may
    stand in a code fence. Any other failure is the caller's.
    """
    try:
        answer = run(False)
    except Exception as exc:
        if not rejected(exc):
            raise
        answer = run(True)
    return validate(json.loads(unfenced(answer)) if isinstance(answer, str) else answer)


def unfenced(answer: str) -> str:
    """A text without the one code fence around it."""
    lines = answer.strip().splitlines()
    if not lines or not lines[0].startswith("```"):
        return answer.strip()
    return "\n".join(lines[1:-1] if lines[-1].strip() == "```" else lines[1:]).strip()
