"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_ATOMS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "date": T.DateType(), "binary": T.BinaryType(),
}


# ``StructType.fromDDL`` needs a running session; schemas are constants of modules that are imported before one.


def _split(text: str) -> list[str]:
    """Parts between commas that are not inside angle brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def _type(text: str) -> T.DataType:
    kind, _, inner = text.partition("<")
    inner = inner[:-1]
    if kind == "array":
        return T.ArrayType(_type(inner))
    if kind == "map":
        return T.MapType(*map(_type, _split(inner)))
    if kind == "struct":
        return ddl(", ".join(" ".join(f.partition(":")[::2]) for f in _split(inner)))
    return _ATOMS[text]


def ddl(text: str) -> T.StructType:
    """A schema from ``name type`` pairs; needs no session, so modules can hold schemas as constants."""
    return T.StructType([T.StructField(*(lambda n, t: (n, _type(t.strip())))(*f.split(" ", 1))) for f in _split(text)])


STORE = {
    "items": ddl("item_id string, knowledge_class string, item_type string, item_shape string, schema_version string, payload_json string, canonical_hash string, node_count int, target_count int"),
    "nodes": ddl("item_id string, node_id string, parent_id string, position int, payload_json string, content_hash string"),
    "records": ddl(
        "target_id string, item_id string, node_id string, item_type string, matched_text string, as_of timestamp, available_at timestamp, source_kind string, confidence string, tags array<string>,"
        " tree_id string, embedding_model string, dimension int, projection_hash string, source_content_hash string, knowledge_schema_version string, projection_schema_version string,"
        " item_canonical_hash string, embedding array<float>"
    ),
    "sources": ddl("source_revision_id string, content_hash string, kind string, uri string, as_of timestamp, available_at timestamp, published_at timestamp, arxiv_id string, title string, authors array<string>, payload_json string, canonical_hash string, asset_count int"),
    "assets": ddl("asset_id string, source_revision_id string, kind string, page_number int, media_type string, content_hash string, size_bytes bigint, blob binary"),
    "artifacts": ddl("artifact_id string, source_revision_id string, artifact_kind string, schema_version string, producer_config_hash string, payload_json string, canonical_hash string, member_count int, target_count int"),
    "members": ddl("artifact_id string, member_id string, parent_id string, position int, payload_json string, content_hash string"),
    "lineage": ddl("artifact_id string, input_artifact_id string, relation string"),
    "projections": ddl("target_id string, artifact_id string, member_id string, source_revision_id string, matched_text string, projection_hash string, embedding_model string, dimension int, projection_schema_version string, embedding array<float>"),
}

FEED_ITEM = ddl("feed_url string, feed_title string, title string, url string, id string, published_at timestamp, summary_html string, content_html string, raw map<string,string>")
LISTING_ROW = ddl("page_number int, row_number int, page_date date, href string, title string, timestamp_text string, raw_html string")
FETCHED = ddl("url string, resolved_url string, status int, content_type string, headers map<string,string>, body binary, fetched_at timestamp, error_type string, message string, attempts int")
SPAN = ddl(
    "span_id string, parent_id string, trace_id string, type string, name string, model string, started_at string, ended_at string, usage map<string,bigint>,"
    " response struct<model string, usage struct<input_tokens bigint, output_tokens bigint, total_tokens bigint>>"
)
