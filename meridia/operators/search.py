"""Metadata filters, exact vector ranking and hit resolution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SemanticQuery:
    """What to look for. Empty collections and None do not restrict."""

    text: str
    top_k: int = 10
    artifact_kinds: tuple[str, ...] = ()
    item_types: tuple[str, ...] = ()
    source_kinds: tuple[str, ...] = ()
    confidence: str | None = None
    tags: tuple[str, ...] = ()
    tree_id: str | None = None
    as_of: datetime | None = None
    available_at: datetime | None = None

    def __post_init__(self):
        object.__setattr__(self, "text", self.text.strip())
        if not self.text:
            raise ValueError("a query needs text")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        for name in ("as_of", "available_at"):
            value = getattr(self, name)
            if value is not None and value.tzinfo is None:
                raise ValueError(f"{name} needs a time zone")

    def predicates(self) -> list[Column]:
        out = [F.col(c).isin(*v) for c, v in (("artifact_kind", self.artifact_kinds), ("item_type", self.item_types), ("source_kind", self.source_kinds)) if v]
        out += [F.col(c) == v for c, v in (("confidence", self.confidence), ("tree_id", self.tree_id)) if v is not None]
        if self.tags:
            out.append(has_tags(F.col("tags"), self.tags))
        out += [F.col(c) <= F.lit(v) for c, v in (("as_of", self.as_of), ("available_at", self.available_at)) if v is not None]
        return out


def has_tags(tags: Column, required: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), tags)) == 0


def matching(index: DataFrame, query: SemanticQuery) -> DataFrame:
    """Rows that satisfy every restriction. A row of unknown availability fails an availability cut-off."""
    return reduce(DataFrame.where, query.predicates(), index)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def valid_vector(v: Column, dimension: int | None = None) -> Column:
    """Right length, finite components and not zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dimension if dimension else F.size(v) > 0), F.lit(False))


def rank(index: DataFrame, vector: list[float] | Column, top_k: int, key: str = "target_id", embedding: str = "embedding") -> DataFrame:
    """(key, score) of the top_k most similar rows, best first, ties by key.

    Only key and vector go through the scan; callers join what else they need
    to the few rows that are left. Rows of another dimension are an error.
    """
    q = vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])
    same = F.when(F.size(embedding) == F.size(q), F.col(embedding)).otherwise(F.raise_error(F.lit("the index has another dimension than the query")).cast("array<float>"))
    return index.select(key, cosine(same, q).alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def search(index: DataFrame, query: SemanticQuery, embed: Callable[[str], list[float]]) -> DataFrame:
    """Hits of a query: filter, rank, then the payload. The text is embedded only if something is left to rank."""
    candidates = matching(index, query)
    if candidates.limit(1).count() == 0:
        return candidates.withColumn("score", F.lit(0.0))
    top = rank(candidates, embed(query.text), query.top_k)
    return index.join(F.broadcast(top), "target_id").orderBy(F.desc("score"), "target_id")  # top_k rows


def stale(current: DataFrame, stored: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Rows of ``current`` to embed anew: missing in ``stored``, or different in a compared column (null equals null)."""
    old = stored.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in compared])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in compared])
    return current.join(old, current[key] == old["_key"], "left").where(F.col("_key").isNull() | differs).select(*current.columns)


def latest_as_of(rows: DataFrame, key: str, time: str, cutoff: Column, tie: str) -> DataFrame:
    """The last row of each key at or before the cut-off; aggregates before it shuffles, so a busy key is no burden."""
    rest = [c for c in rows.columns if c not in (key, time, tie)]
    packed = F.max(F.struct(time, tie, *rest)).alias("last")
    return rows.where(F.col(time) <= cutoff).groupBy(key).agg(packed).select(key, "last.*").select(*rows.columns)
