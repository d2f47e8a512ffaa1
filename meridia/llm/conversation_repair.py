r"""Conversation structure repair as a shortest path.

A conversation is in order if its roles are an optional system turn and then
one or more pairs of user and assistant, or if it has no turn. Faults of
single turns are found with windows. The cheapest edits that bring a
conversation into order are a shortest path over (turn, state of the grammar),
whose arcs have costs of 0 to 6: Dial's algorithm takes nodes from a ring of
seven buckets, one for each cost modulo seven, and records every node's distance to the
goal. The audit then follows arcs that lie on shortest paths (tight arcs), from the
start, always the one whose letter comes first.

Python sees one letter for each turn and gives back which turns stay, under which
role; texts stay in the JVM.
"""

from __future__ import annotations

from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
ROLES = {"s": "system", "u": "user", "a": "assistant"}

# states: nothing yet, after a system turn, after a user turn, after an assistant turn
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_MAY = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_DUE = (_USER, _USER, _ASSISTANT, _USER)  # the state after the turn that may be put in
_DUE_ROLE = ("user", "user", "assistant", "user")
_RING = RETYPE + TRUNCATED + 1


def _arcs(symbol: str) -> list[list[tuple[str, int, int]]]:
    """For each state, the ways past a turn: (letter, state after it, cost), by letter."""
    out = []
    for state in range(4):
        ways = [("D", state, DELETE)]
        if symbol != "-":
            more = TRUNCATED if symbol.isupper() else 0
            if symbol.lower() in _MAY[state]:
                ways.append(("K", _MAY[state][symbol.lower()], more))
            ways.append(("R", _DUE[state], RETYPE + more))
        out.append(ways)
    return out


ARCS = {symbol: _arcs(symbol) for symbol in "suaxSUAX-"}
BACK = {symbol: [[(p, cost) for p in range(4) for _, q, cost in ways[p] if q == state] for state in range(4)] for symbol, ways in ARCS.items()}
_PUT_BACK = [[p for p in range(4) if _DUE[p] == state] for state in range(4)]


def distances(symbols: str) -> array:
    """The cheapest cost from each node (4 * turn + state) to a conversation in order, by Dial's buckets from the goal backwards."""
    n = len(symbols)
    dist = array("q", [-1]) * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(_RING)]
    best = {4 * n + _START: 0, 4 * n + _ASSISTANT: 0}
    ring[0] += best
    at, waiting = 0, 2
    while waiting:
        bucket = ring[at % _RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] >= 0:
                continue
            dist[node] = at
            best.pop(node, None)
            turn, state = divmod(node, 4)
            before = [(4 * turn + p, at + INSERT) for p in _PUT_BACK[state]]
            if turn:
                before += [(4 * turn - 4 + p, at + cost) for p, cost in BACK[symbols[turn - 1]][state]]
            for node, cost in before:
                if dist[node] < 0 and cost < best.get(node, cost + 1):
                    best[node] = cost
                    ring[cost % _RING].append(node)
                    waiting += 1
        at += 1
    return dist


def shortest(symbols: str) -> tuple[int, str, list[int], list[str | None]]:
    """Cost, audit, and the turns of the repaired conversation: their index (-1: put in) and their new role (None: as it is).

    Symbols: the initial of a role, x for others, in upper case if the text is
    truncated; - for a turn that has to go.
    """
    dist = distances(symbols)
    turn, state, n = 0, _START, len(symbols)
    audit, kept, roles = [], [], []
    while dist[4 * turn + state]:
        left = dist[4 * turn + state]
        ways = [(letter, turn + 1, q, cost) for letter, q, cost in ARCS[symbols[turn]][state]] if turn < n else []
        ways.append(("I", turn, _DUE[state], INSERT))
        letter, to, q = min((letter, to, q) for letter, to, q, cost in ways if cost + dist[4 * to + q] == left)
        audit.append(letter)
        if letter != "D":
            kept.append(-1 if letter == "I" else turn)
            roles.append(None if letter == "K" else _DUE_ROLE[state])
        turn, state = to, q
    for turn in range(turn, n):  # what is left costs nothing: every turn is kept
        audit.append("K")
        kept.append(turn)
        roles.append(None)
    return dist[_START], "".join(audit), kept, roles


def _repairs(symbols: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple] = {}
    out = []
    for s in symbols:
        if s not in known:
            if len(known) > 1000:
                known.clear()
            known[s] = shortest(s)
        out.append(known[s])
    return pd.DataFrame(out, columns=["cost", "audit", "kept", "roles"])


PATH = "cost long, audit string, kept array<int>, roles array<string>"


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text without nulls) with pos, gap_end (the first of its turn), illegal and fault (blank, duplicate, truncated or null)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    src = rows.select(
        "*",
        F.row_number().over(order).alias("pos"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False))).alias("new_turn"),
        F.coalesce(~F.concat(F.lag(initial).over(order), initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated")
    return src.withColumn("seen", seen).withColumn("fault", fault).drop("seen")


def _symbol(t: Column) -> Column:
    initial = F.substring(t["role"], 1, 1)
    letter = F.when(initial.isin(*ROLES), initial).otherwise("x")
    return F.when(t["fault"].isin("blank", "duplicate"), "-").when(t["fault"] == "truncated", F.upper(letter)).otherwise(letter)


def repair(spark: SparkSession, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: array of (role, text).

    Turns go by ``turn``, nulls first, ties by role, then text. A null role or
    text is one space; rows with a null conversation form one. Each turn's
    first fault counts: blank, duplicate (its role and text were there before),
    truncated (no ``.``, ``!`` or ``?`` at its end). Keeping a turn (K) costs
    nothing, a new role (R) 3, deleting (D) 4, putting in an empty turn (I) 3;
    blank and duplicate turns must go, and a truncated turn that stays adds 3.
    Of equally cheap audits the first in byte order is taken. Texts may be of
    any length, other columns are ignored, an empty table gives no rows.

    Audit and repaired conversation are one value each, so one task holds a
    conversation; there is one shuffle, by conversation.
    """
    bounded(spark)
    blank = F.lit(" ")
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    counted = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    each = faults(src).groupBy("conv_id").agg(
        F.coalesce(gaps.cast("long"), F.lit(0).cast("long")).alias("gaps"), *counted, F.count_if("illegal").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", "fault"))).alias("turns"),
    )
    path = F.pandas_udf(_repairs, PATH)
    found = each.withColumn("path", path(F.array_join(F.transform("turns", _symbol), "")))

    def made(x: Column) -> Column:
        own = F.get("turns", x["kept"])
        return F.struct(F.coalesce(x["roles"], own["role"]).alias("role"), F.coalesce(own["text"], F.lit("")).alias("text"))

    repaired = F.transform(F.arrays_zip(F.col("path.kept").alias("kept"), F.col("path.roles").alias("roles")), made)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "path.cost", "path.audit", repaired.alias("repaired"))


def digests(repaired: DataFrame) -> DataFrame:
    """The repaired conversations as hashes of their ``role:text`` lines."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repaired.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults put in by ``crc32(conv_id:turn) % 20``; nulls of ids, turns, roles and texts are one space there, and turns stay null."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    src = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(named) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return src.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
