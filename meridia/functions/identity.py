"""Content hashes and name-based identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_url, strip

# fixed values: the URL namespace of RFC 4122, prefixes by source type
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
PREFIXES = {"company_8k": "sec", "press_release": "wire", "publisher_news": "publisher", "regulatory_news": "regulatory"}


def uuid5(namespace: Column, name: Column) -> Column:
    """Version 5 identifier of a name; the namespace is a dashed identifier."""
    space = F.unhex(F.regexp_replace(namespace, "-", ""))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_id(content_hash: Column, prefix: str = "meridia") -> Column:
    return uuid5(F.lit(URL_NAMESPACE), F.concat(F.lit(f"{prefix}:paper-source:"), content_hash))


def artifact_id(source: Column, kind: Column, config_hash: Column, prefix: str = "meridia") -> Column:
    return uuid5(source, F.concat_ws(":", F.lit(prefix), kind, config_hash))


def asset_id(source: Column, kind: Column, page: Column, content_hash: Column, prefix: str = "meridia") -> Column:
    return uuid5(source, F.concat_ws(":", F.lit(prefix), F.lit("paper-asset"), kind, F.coalesce(page.cast("string"), F.lit("document")), content_hash))


def chunk_id(chunk_set: Column, position: Column, content_hash: Column, span_hash: Column, prefix: str = "meridia") -> Column:
    return uuid5(chunk_set, F.concat_ws(":", F.lit(prefix), F.lit("paper-chunk"), position.cast("string"), content_hash, span_hash))


def parsed_chunk_id(source_hash: Column, page: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_hash, page.cast("string"), start.cast("string"), end.cast("string"), text), 256)


def target_id(item: Column, node: Column) -> Column:
    return F.when(node.isNull(), F.concat(F.lit("item:"), item)).otherwise(F.concat(F.lit("node:"), item, F.lit(":"), node))


def news_identity(source_type: Column, payload_id: Column, url: Column) -> Column:
    """Prefix and hash of the payload id, or of the canonical address; null with neither."""
    names = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    key = F.coalesce(F.nullif(strip(payload_id), F.lit("")), F.nullif(canonical_url(F.nullif(strip(url), F.lit(""))), F.lit("")))
    return F.concat(F.element_at(names, source_type), F.lit(":"), F.sha2(key, 256))


def filing_identity(accession: Column, section: Column) -> Column:
    a, s = strip(accession), F.lower(strip(section))
    return F.when((a != "") & (s != ""), F.concat(F.lit("sec:"), a, F.lit(":"), s))


def ordered_hash(items: Column) -> Column:
    """Hash of an array of structs in the order of their first field."""
    return F.sha2(F.to_json(F.array_sort(items), {"ignoreNullFields": "false"}), 256)
