"""Chat formatting by grammar round trip, in DataFrame functions only.

A turn is rendered as ``<s>[INST]role[/INST]text</s>`` and a conversation as
its turns one after another. The parser is deterministic: it cuts at ``</s>``,
takes what stands between ``<s>[INST]`` and ``[/INST]`` as the role and the
rest as the text, and refuses a turn in which a control string is left. Every turn is first rendered as it is and parsed; where the
parser does not give the turn back, its content is escaped and parsed again.
The finished conversation is parsed once more and must equal the source.

Escaping puts one backslash after the first character of each control string,
also of those that already have backslashes there; unescaping takes one away.
So ``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``, and no text
needs more than one step. A control string has ``<`` or ``[`` only at its
start, so none can arise across the border of a text and a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_ANY = r"(?:/?s>|/?INST\])"
_CONTROL = rf"([<\[])(?=\\*{_ANY})"
_ESCAPED = rf"([<\[])\\(?=\\*{_ANY})"


_BARE = r"</?s>|\[/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def _turn(piece: Column) -> Column:
    """(role, text) of one rendered turn without its end marker; null if the opening is missing."""
    parts = F.split(F.substring(piece, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2)
    return F.when(
        piece.startswith(OPEN) & (F.size(parts) == 2) & ~F.exists(parts, lambda p: p.rlike(_BARE)),
        F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text")),
    )


def parse(rendered: Column) -> Column:
    """array<struct<role,text>> read from a rendered conversation; anything after the last end marker is one more, null, turn."""
    pieces = F.split(rendered, CLOSE, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform(whole, _turn)
    rest = F.get(pieces, F.size(pieces) - 1)
    return F.when(rest == "", turns).otherwise(F.concat(turns, F.array(F.lit(None).cast("struct<role:string,text:string>"))))


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, n_turns.

    loss_spans holds [start, end) in code points of ``formatted`` for the text
    of each ``loss_role`` turn, in order. Turns go by ``turn`` (nulls first),
    ties by role, then text; repeated rows are turns of their own. A null role
    or text is the empty string; rows with a null conversation form one. An
    empty table gives no rows; other columns are ignored.
    A conversation is one value and is held by one task; conversations are not
    split.
    """
    src = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    plain = F.concat(F.lit(OPEN), F.col("role"), F.lit(MID), F.col("text"))
    same = parse(F.concat(plain, F.lit(CLOSE))).eqNullSafe(F.array(F.struct("role", "text")))
    src = src.withColumn("same", same)
    src = src.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"))).alias("role_x"),
        F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))).alias("text_x"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    src = src.withColumn("rendered", render(F.col("role_x"), F.col("text_x")))
    src = src.select(
        "conv_id", "role", "text", "rendered",
        F.row_number().over(order).alias("pos"),
        F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.length("text_x").alias("n_x"),
    )
    grouped = src.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text", "rendered", "end", "n_x"))).alias("t"))
    stop = len(CLOSE)
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source_turns"),
        F.transform(
            F.filter("t", lambda x: x["role"] == loss_role),
            lambda x: F.struct((x["end"] - stop - x["n_x"]).alias("start"), (x["end"] - stop).alias("end")),
        ).alias("loss_spans"),
    )
    checked = F.when(parse(F.col("formatted")).eqNullSafe(F.col("source_turns")), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation did not survive its round trip"))
    )
    return out.select("conv_id", checked.alias("formatted"), "loss_spans", F.size("source_turns").cast("long").alias("n_turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    out = formatted.withColumn("turn_texts", turns).withColumn("learnt", F.array_join(learnt, ""))
    return out.select(
        "conv_id",
        F.size("turn_texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turn_texts", ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
