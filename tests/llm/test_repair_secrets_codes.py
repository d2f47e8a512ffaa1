"""Conversation repair, secret scans and vector codes against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import conversation_repair as repair
from meridia.llm import secret_scan, vector_codes

# --- conversation repair ---

MAY = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """rows: (role, text) in order. Cheapest edits by trying all states of all prefixes; (faults, illegal, cost, audit, repaired)."""
    kinds, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    full = {"u": "user", "a": "assistant"}
    now = {"": (0, "", ())}

    def put_in(states):
        for _ in range(4):
            for last, (cost, audit, out) in list(states.items()):
                due = "a" if last == "u" else "u"
                new = (cost + 3, audit + "I", (*out, (full[due], "")))
                if due not in states or new[:2] < states[due][:2]:
                    states[due] = new
        return states

    now = put_in(now)
    for (role, text), kind in zip(rows, kinds):
        after = {}
        for last, (cost, audit, out) in now.items():
            ways = [(last, cost + 4, "D", out)]
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                if role[:1] and role[:1] in MAY[last]:
                    ways.append((role[:1], cost + more, "K", (*out, (role, text))))
                due = "a" if last == "u" else "u"
                ways.append((due, cost + 3 + more, "R", (*out, (full[due], text))))
            for state, c, letter, o in ways:
                if state not in after or (c, audit + letter) < after[state][:2]:
                    after[state] = (c, audit + letter, o)
        now = put_in(after)
    cost, audit, out = min((now[s] for s in ("", "a") if s in now), key=lambda x: x[:2])
    return collections.Counter(kinds), illegal, cost, audit, out


TEXTS = ["Yes.", "no", "", " \n", "Why?", "Go! ", "a\x85", "x. ", None, "Yes. \x0b"]


def test_repair_matches_a_plain_version(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles[:3] if c % 2 else roles), rng.choice(TEXTS)) for c in range(150) for _ in range(rng.randint(1, 9))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (900, 2**40, "user", "Far."), (900, 1, "assistant", "Near.")]
    rows += [(901, i, "ua"[i % 2].replace("u", "user"), f"{i} ." * (20_000 if i == 3 else 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x")).withColumn("fault", F.lit(1)).withColumn("path", F.lit(0))
    got = {r["conv_id"]: r for r in repair.repair(spark, df).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        kinds, illegal, cost, audit, out = plain_repair([x[1:] for x in turns])
        r, known = got[c], {t for t, _, _ in turns if t >= 0}
        assert (r["cost"], r["audit"], [tuple(x) for x in r["repaired"]]) == (cost, audit, list(out)), turns
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal)
        assert r["gaps"] == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in r["repaired"]))
    assert repair.repair(spark, df.limit(0)).count() == 0


def test_equal_costs_take_the_first_audit():
    assert repair.shortest("u")[:2] == (3, "KI") and repair.shortest("a")[:2] == (3, "IK") and repair.shortest("-")[:2] == (4, "D")
    assert repair.shortest("S")[:2] == (4, "D") and repair.shortest("uu")[:2] == (3, "KR")


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(4)] + [(None, None, None, None), (7, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.Counter(tuple(r) for r in repair.damaged(df).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[(c, t, "user" if kind == 4 else role, text)] += (kind != 0) + (kind == 3)
    assert got == +want


# --- secret scans ---

FORMS = {
    "assign": (re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def plain_scan(text):
    out = [(m.start(), k, kind, m.end()) for k, (kind, (p, group, least)) in enumerate(FORMS.items()) for m in p.finditer(text) if len(m.group(group)) >= least]
    return sorted(out)


PIECES = ["token", "Api_Key", "apikey", "PASSWORD", "passwd", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "f", "é", "😀", "\n", "abc.def-ghi", "x", "ſecret", "toKen", "z" * 9, "a1" * 20]


def test_scan_matches_a_plain_version(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["secret=token: abcdefghij", "token==abcdefgh", "AKIAAKIA12345678", "AKIA" + "A" * 11, "g" + "a" * 31 + "g" + "b" * 32, "", 'token = "abcdefghi" ' * 20_000, "x" * 300_000 + "AKIA" + "Q" * 12]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9001, None), (None, "token=12345678"), (None, "token=12345678"), (3, "AKIA" + "Z" * 12), *[(20_000 + i, "secret: " + "k" * 10) for i in range(50)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("kinds", F.lit("x")).withColumn("gram", F.lit("x"))
    base = secret_scan.RULES[:3]
    for few in (10**6, 0):
        got = collections.Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in secret_scan.scan(spark, df, base, broadcast_texts=few).collect())
        assert got == collections.Counter((i, tuple(plain_scan(t or ""))) for i, t in rows)
    digest = {r["doc_id"]: r for r in secret_scan.digests(secret_scan.scan(spark, df.where("doc_id is not null"))).collect()}
    for i, t in rows[:1500]:
        assert i == 3 or digest[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in plain_scan(t)).encode()).hexdigest()
    assert secret_scan.scan(spark, df.limit(0)).count() == 0


def test_further_kinds_are_added(spark):
    keys = ["ghp_" + "a1B2" * 9, "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "ghx_" + "z" * 40]
    df = spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.digests(secret_scan.scan(spark, df)).collect()}
    assert got == {0: "github:0:40", 1: "google:0:39", 2: "pem:0:31", 3: ""}


def test_trigram_queries_never_miss():
    """A text that matches holds all trigrams of one of the sets."""
    rng = random.Random(2)
    samples = {r"(ab|cd)?efg[hi]j{2,4}k": ["efghjjk", "abefgijjjk", "cdefghjjjjk"], r"(?i)(foo|bar)+baz": ["FOObarBaz", "barbaz"], r"x(?=abc)[a-z]{3}def": ["xabcdef"], r"a{3}b?c": ["aaac", "aaabc"]}
    for pattern, texts in samples.items():
        sets = secret_scan.trigram_query(pattern)
        for t in texts:
            assert re.search(pattern, t) and any(all(g in t.lower() for g in s) for s in sets), (pattern, t, sets)
    for r in secret_scan.RULES[:2]:
        for _ in range(300):
            t = "".join(rng.choice(PIECES) for _ in range(8))
            if re.search(r.pattern, t, re.ASCII):
                assert any(all(g in t.lower() for g in s) for s in secret_scan.trigram_query(r.pattern))
    assert secret_scan.trigram_query(r"[0-9a-f]{32,}") is None and secret_scan.trigram_query(r"abcd|x") is None
    assert secret_scan.trigram_query("abcd|abc") == [frozenset({"abc"})]


def test_only_candidates_are_verified(spark, monkeypatch):
    """The rules reach the texts whose posting lists meet, and no others, but for rules without trigrams."""
    texts = ["a token here", "tok oken ken", "api and key", "nothing", "pass word", "the password"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", secret_scan.text_key(F.col("text")))
    queries = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES[:2]}
    ws = secret_scan.Workspace(spark, "t")
    named = secret_scan.candidates(spark, secret_scan.build_index(ws, df, queries), queries)
    assert {r["text"] for r in df.join(named, "key").collect()} == {"a token here", "tok oken ken", "the password"}


# --- vector codes ---


def plain_codes(rows, parts=4, rounds=4):
    """rows: (id, vector) that are kept, one dimension."""
    q = np.array([[int(np.floor(1024 * float(x))) for x in v] for _, v in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    d = q.shape[1]
    cut = [i * d // parts for i in range(parts + 1)]
    books = [[list(q[i, cut[p] : cut[p + 1]]) for i in order[:256]] for p in range(parts)]

    def assign():
        out = []
        for v in q:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[cut[p] : cut[p + 1]], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in {g[p][1] for g in got}:
                mine = [q[i, cut[p] : cut[p + 1]] for i, g in enumerate(got) if g[p][1] == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{k:02x}" for _, k in g), sum(f for f, _ in g)) for g in got], digest


@pytest.mark.parametrize("dim", [8, 6])
def test_codes_match_a_plain_version(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=dim), 1).astype(np.float32)], int(i) % 3) for i in rng.permutation(320)]
    rows += [(None, [0.5] * dim, None), (7, [0.0] * dim, 1), (7, [0.0] * dim, 1), (1000, [-1e30] + [3e38] * (dim - 1), None)]
    rows += [(2000 + i, [0.25] * dim, 2) for i in range(150)]
    odd = [(3000, None, 1), (3001, [float("nan")] * dim, 1), (3002, [None] + [1.0] * (dim - 1), 1), (3003, [float("inf")] * dim, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("dim", F.lit("x"))
    got = vector_codes.compress(spark, df.repartition(7)).collect()
    most = 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)
    held = [(i, [float(np.clip(x, -most / 1024, most / 1024)) for x in np.array(v, dtype=np.float32).astype(float)]) for i, v, _ in rows]
    want, digest = plain_codes(held)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == sorted((str(i), c, e) for (i, _, _), (c, e) in zip(rows, want))
    assert {r["codebooks_sha256"] for r in got} == {digest}
    sums = collections.Counter()
    for (_, _, label), (_, e) in zip(rows, want):
        sums[label] += e
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_codes_of_other_dimensions_and_none(spark, monkeypatch):
    """Each dimension has codebooks of its own, also when they take several passes; empty vectors have a code without error."""
    rows = [(i, [float(i)] * (4 if i % 2 else 5), 0) for i in range(40)] + [(50, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for most in (10**6, 1):
        monkeypatch.setattr(vector_codes, "BROADCAST", most)
        got = vector_codes.compress(spark, df).collect()
        assert len(got) == 41 and len({r["codebooks_sha256"] for r in got}) == 3 and all(r["error"] == 0 for r in got)
    assert vector_codes.compress(spark, df.limit(0)).collect() == []


def test_the_tree_keeps_lower_indexes_of_equal_entries():
    rng = np.random.default_rng(4)
    for width in (0, 1, 2, 16):
        entries = rng.integers(-3, 4, (200, width))
        entries[100:] = entries[50]
        queries = rng.integers(-5, 6, (800, width))
        index, far = vector_codes.Tree(entries).nearest(queries)
        whole = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
