"""Chat formatting, packing, personal data, pieces and n-gram joins against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridia.llm import chat, ngram_join, packing, pieces, pii
from meridia.llm.queries import tokenizer_path
from meridia.llm.tokens import WordTokenizer

ODD = ["", None, "</s>", "<s>[INST]x[/INST]</s>", "<\\s>", "<\\\\/s>[/INST]", "[INST] [\\INST] <", "</s", "é\n\\", "a" * 5000]


def docs(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumn("lang", F.lit("x")).withColumn("length", F.lit(1)).withColumn("sig", F.lit("s")) if extra else df


# --- chat ---


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a</s>", None]), rng.choice(ODD)) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(None, None, "user", "x"), (50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (51, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0)).withColumn("pos", F.lit(0))
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    texts = {r["conv_id"]: r for r in formatted.collect()}
    plain = collections.defaultdict(list)
    for c, t, r, x in rows:
        plain[c].append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == plain.keys()
    for c, turns in plain.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["turns_sha256"], got[c]["loss_sha256"], got[c]["loss_chars"], got[c]["n_turns"]) == (want, hashlib.sha256(learnt.encode()).hexdigest(), len(learnt), len(turns))
        assert len(texts[c]["formatted"]) == got[c]["formatted_chars"]
        assert texts[c]["formatted"].count("</s>") == len(turns)


def test_chat_leaves_plain_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b [c]")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first()["formatted"] == "<s>[INST]user[/INST]a < b [c]</s>"
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- packing ---


def test_nnls():
    rng = np.random.default_rng(1)
    a = rng.random((20, 12))
    x = np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1: 1}, {1000: 7, 1048: 5, 3: 100}, {n: n % 5 for n in range(1, 2049)}, {700: 300_000_000, 648: 10}])
def test_plan_places_every_length(counts):
    rows, n = packing.plan(counts)
    placed = collections.Counter()
    total = 0
    for length, first, k, seq, at, size in rows.tolist():
        assert first == placed[length] and at + k * length <= size <= 2048
        end = min([s for s in sorted(set(rows[:, 3].tolist())) if s > seq], default=n)
        placed[length] += k * (end - seq)
        total += k * length * (end - seq)
    assert placed == {k: v for k, v in counts.items() if v}


def test_pack(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "word", "it's", "é", "12"]) for _ in range(rng.choice([0, 1, 5, 300, 3000]))) for _ in range(120)] + [None, "", "same " * 900, "same " * 900]
    df = docs(spark, texts).unionByName(docs(spark, ["again"]).withColumn("doc_id", F.lit(3).cast("long")))
    path = tokenizer_path("word_bpe_49k.json")
    placed = packing.pack(spark, df, path)
    rows = placed.collect()
    tok = WordTokenizer(path).tok
    want = collections.Counter(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*texts, "again"])
    got = collections.Counter(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert got == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for seq in by.values():
        seq.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in seq]).tolist()
        assert [r["offset"] for r in seq] == [0, *ends[:-1]] and ends[-1] <= seq[0]["padded_length"] <= 2048
    assert sorted(by) == list(range(len(by)))
    unique = docs(spark, texts)
    packed = packing.pack(spark, unique, path)
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed, unique, path).collect()}
    for r in packed.collect():
        part = np.array(joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert packing.pack(spark, df.limit(0), path).count() == 0


def test_word_tokenizer_is_exact():
    tok = WordTokenizer(tokenizer_path("word_bpe_49k.json"), limit=200)
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab 'sé.²́\n ÉΣ0<|>x\x1c“") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "<|endoftext|>", "DON'T it's", "x" * 3000]
    for t, ids in zip(texts, tok.encode(pa.array(texts))):
        assert ids.tolist() == tok.tok.encode(t or "", add_special_tokens=False).ids


def test_word_tokenizer_takes_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    fresh = Tokenizer.from_file(path)
    rng = random.Random(20)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", " ", "\n", "hi", "There", "é", "Σ", "\u212a", "\u017f", "'s", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)] + ["hi <|endoftext|> there", None]
    got = WordTokenizer(path).encode(pa.array(texts))
    assert got[2000].tolist() == [1883, 49407, 997]
    for t, ids in zip(texts, got):
        assert ids.tolist() == fresh.encode(t or "", add_special_tokens=False).ids


# --- pieces ---


def test_pieces_are_exact():
    enc = pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"), limit=300)
    rng = random.Random(9)
    alphabet = "ab é.▁\n 0the in  ▁▁日aaaá\x00!!.,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["a" * 3000, " " * 50, " x ", None, ""]
    for t, ids in zip(texts, enc.encode(pa.array(texts))):
        assert ids.tolist() == enc.library.encode(t or "", add_bos=True, add_eos=True)
        assert enc.decode(ids) == enc.library.decode(ids.tolist())


def test_pieces_query(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    df = docs(spark, ["Hello  world", None, "", "x" * 20_000, "Hello  world"])
    got = {r["doc_id"]: r for r in pieces.encode(df, path).collect()}
    assert got[0]["decoded"] == "Hello  world" and got[1]["n_tokens"] == got[2]["n_tokens"] == 2 and got[0]["ids"] == got[4]["ids"] and got[3]["decoded"] == "x" * 20_000
    assert pieces.encode(df.limit(0), path).count() == 0


# --- personal data ---

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(t):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("a1.@_-+ 4é(😀)") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x a.b@c.d_e@f.g, 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (499) 555-6503.", "a" * 100_000, "1" * 50_000, "+1" + "(" * 50_000, "1.1." * 9_000, None, ""]
    got = {r["doc_id"]: r for r in pii.digests(pii.find(spark, docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i]["n_email"] == sum(w.startswith("email") for w in want)


def test_disclosing_terms(spark):
    texts = [f"word{'abcdefghij'[i % 10]} text of no matter number{'xyz'[i % 3]}" for i in range(200)]
    texts += [f"ask about{'abcdef'[i]} Zorblatt at boss@corp.example for{'abcdef'[i]} things" for i in range(6)]
    df = docs(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(spark, df)).collect()}
    at = texts[200].index("Zorblatt")
    assert f"term:{at}:{at + 8}" in spans[200] and spans[0] == ""
    out = pii.sanitise(spark, df, ("doc_id", "text", "lang")).where("doc_id = 200").first()["text"]
    assert "Zorblatt" not in out and "[EMAIL]" in out and out.startswith("ask about")


def test_disclosing_terms_of_whole_documents(spark):
    """A heading and a number far from the address; equal texts are one observation."""
    rng = random.Random(21)
    fill = lambda n: " ".join(rng.choice(["some", "text", "of", "no", "weight", "that", "goes", "on"]) for _ in range(n))
    texts = [fill(60) for _ in range(200)]
    texts += [f"Quenby {fill(50)} write to boss@corp.example {fill(50)} Ixby 4711" for _ in range(5)]
    texts += ["Onlycopy same for everyone " + fill(9) + " other@corp2.example"] * 7
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs(spark, texts), ("doc_id", "text")).collect()}
    for i in range(200, 205):
        assert "[EMAIL]" in out[i] and not any(w in out[i] for w in ("Quenby", "Ixby", "4711"))
        assert "write" not in out[i] and out[i].count("some") == texts[i].count("some")
    assert all(out[i] == texts[i] for i in range(200))
    assert all(out[i].startswith("Onlycopy same for everyone") for i in range(205, 212))


def plain_terms(texts, generalise_at=0.9, support=3):
    """Disclosing words by loops: (entity, term) of different texts, by shares of the entity's information."""
    texts = set(texts)
    words = {t: set(re.findall(r"[^\W_]{4,}", t.lower())) for t in texts}
    entities = collections.defaultdict(set)
    for t in texts:
        for e in re.findall(PATTERNS[0][1].replace("(", "(?:"), t):
            entities[e.lower()].add(t)
    out = set()
    for e, held in entities.items():
        if len(held) >= support:
            for w in set().union(*(words[t] for t in held)):
                both = sum(w in words[t] for t in held)
                df = sum(w in ws for ws in words.values())
                pmi, ic = math.log(both / len(held) / (df / len(texts))), math.log(len(texts) / len(held))
                if both >= support and ic > 0 and pmi / ic >= generalise_at:
                    out.add((e, w))
    return out


def test_disclosing_terms_equal_a_plain_count(spark):
    rng = random.Random(23)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    texts = []
    for i in range(240):
        who = i % 8
        own = [f"project{who}", "Quill7"] if rng.random() < 0.9 else []
        text = " ".join(rng.choices(vocabulary, k=12) + own)
        texts.append(text + (f" mail p{who}@corp.example now" if who < 4 and i < 200 else ""))
    df = docs(spark, texts)
    want = plain_terms(texts)
    assert want
    for r in pii.find(spark, df).where("text is not null").collect():
        mine = {w for e, w in want if e in r["text"]}
        base = [(s["start"], s["end"]) for s in r["base"]]
        spots = {(m.start(), m.end()) for w in mine for m in re.finditer(rf"(?i)(?<![^\W_]){w}(?![^\W_])", r["text"])}
        assert {(s["start"], s["end"]) for s in r["terms"]} == {s for s in spots if not any(a < s[1] and s[0] < b for a, b in base)}


def test_secrets(spark):
    """A run that follows a cue is a secret wherever it stands; one that often stands elsewhere is not."""
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(6)]
    texts = [f'text {i} token = "{k}"### and so on {k}' for i, k in enumerate(keys)]
    texts += [f"commit {keys[5]} of day {i}" for i in range(20)] + [f"plain words number {i} of averyveryverylongwordwithoutdigits" for i in range(60)]
    texts += ["API_KEY: Abcdefghij0123456789", "bearer Zyxwvutsrq-9876543210", "token of 20 words", "1234567890123456", None, ""]
    got = {r["doc_id"]: r for r in pii.digests(pii.find(spark, docs(spark, texts))).collect()}
    assert [got[i]["n_secret"] for i in range(6)] == [2] * 5 + [0] and all(got[i]["n_secret"] == 0 for i in range(6, 86))
    assert [got[i]["n_secret"] for i in range(86, 92)] == [1, 1, 0, 0, 0, 0]
    at = texts[0].index(keys[0])
    assert got[0]["spans"].startswith(f"secret:{at}:{at + 40},") and got[0]["n_spans"] == 2
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs(spark, texts), ("doc_id", "text")).collect()}
    assert out[0] == 'text 0 token = "[SECRET]"### and so on [SECRET]' and out[6] == texts[6] and out[90] is None


def test_many_spans_in_one_text(spark):
    text = "x " + " ".join(f"a{i}@b.co" for i in range(10_000))
    out = pii.sanitise(spark, docs(spark, [text]), ("doc_id", "text")).first()["text"]
    assert out == "x " + " ".join(["[EMAIL]"] * 10_000)


def test_sanitised_text(spark):
    df = docs(spark, ["call +1 (499) 555-6503 or a@b.co é 1.2.3.4", None, "", "clean"])
    got = [r["text"] for r in pii.sanitise(spark, df, ("doc_id", "text")).orderBy("doc_id").collect()]
    assert got == ["call [PHONE] or [EMAIL] é [IP]", None, "", "clean"]
    assert pii.find(spark, df.limit(0)).count() == 0


# --- n-gram join ---


def plain_shingles(t, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n,percent,options", [(4, 85, {}), (5, 80, {"rounds": 0, "direct": 2}), (4, 85, {"hot": 4, "direct": 3}), (4, 60, {"rounds": 0, "direct": 2})])
def test_ngram_components(spark, n, percent, options):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = ["", None, " \n", "one", "One", "one two", "ONE\ttwo", "é É", "É É"]
    for _ in range(25):  # chains of edited copies, so that components need more than stars
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 15, 60, 300]))]
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    texts += [" ".join([rng.choice(vocabulary) for _ in range(10)] + passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    sets = [plain_shingles(t or "", n) for t in texts]
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(spark, docs(spark, texts), n, percent, **options).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(sets, percent)


def test_ngram_edges(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f"])
    twice = df.unionByName(df).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = ngram_join.near_duplicates(spark, twice).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {0, None}
    assert ngram_join.keep_first(spark, twice).count() == 2
    assert ngram_join.near_duplicates(spark, df.limit(0)).count() == 0


def test_ngram_ids_with_several_texts(spark):
    """Every text of an id is compared, whatever the order of the rows."""
    rng = random.Random(17)
    a, b = ([rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "alone " + " ".join(map(str, range(50)))), (None, " ".join(a)), (5, None), (5, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").withColumn("own", F.lit(1))
        got = collections.Counter((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(spark, df).collect())
        assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1, (None, None): 1, (5, 5): 2}
        kept = ngram_join.keep_first(spark, df).collect()
        assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 4, 5]


def test_long_lists_are_read_in_parts():
    """Pairs and lists do not depend on where a sorted sequence is cut; of a list its star and its chain are there."""
    rng = random.Random(18)
    rows = sorted((rng.choice([1, 2, 2, 2, 3, rng.randint(4, 40)]), rng.randint(90, 110), d) for d in range(300))
    sig, size, doc = (np.array(x, np.int64) for x in zip(*rows))

    def run(step):
        pairs, lists = set(), []
        for both, (ls, ld, lz) in ngram_join.paired(([x[i : i + step] for x in (sig, doc, size)] for i in range(0, 300, step)), 50, 100, 4):
            pairs |= set(map(tuple, both.tolist()))
            lists += list(zip(ls.tolist(), ld.tolist(), lz.tolist()))
        return pairs, sorted(lists)

    whole = run(300)
    assert all(run(step) == whole for step in (1, 2, 3, 7, 50, 299))
    by = collections.defaultdict(list)
    for s, _, d in rows:
        by[s].append(d)
    for s, ds in by.items():
        near = range(1, len(ds)) if len(ds) <= 4 else (1,)
        assert all((min(x, y), max(x, y)) in whole[0] for k in near for x, y in zip(ds, ds[k:]))
        assert len(ds) <= 4 or all((min(ds[0], x), max(ds[0], x)) in whole[0] for x in ds[1:])
    assert whole[1] == sorted((s, d, z) for s, z, d in rows if len(by[s]) > 4)


def test_sketches_grow_with_the_sets(spark, monkeypatch):
    """Long texts that share passages, but are no near copies, are told apart by their sketches: only copies are read again."""
    rng = np.random.default_rng(19)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = word(2400)
    texts = [" ".join(word(3600) + passage) for _ in range(6)]
    texts += [f"{texts[0]} {' '.join(word(400))}", " ".join(passage[:1000]), " ".join(passage[:1100])]  # over and under a power of two
    near = " ".join(passage[:990] + word(200))
    texts.append(near)
    read, stage = collections.Counter(), ngram_join.Workspace.stage

    def counted(self, df, name):
        out = stage(self, df, name)
        if name in ("pairs", "involved"):
            read[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join.Workspace, "stage", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark, docs(spark, texts), 4, 85, direct=20).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components([plain_shingles(t, 4) for t in texts], 85)
    assert read["pairs"] > 10 and read["involved"] <= 5


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(20)
    rows, want = [], []
    for n, m, common in ((1500, 1500, 1400), (1030, 1100, 1029), (4000, 4200, 3900), (4090, 4100, 4000), (1100, 9000, 1000), (3000, 3000, 0)):
        x = rng.integers(0, 2**63, n + m - common).astype(np.uint64)
        a, b = x[:n], x[n - common :]
        rows.append((ngram_join.wide(a).tolist(), ngram_join.wide(b).tolist()))
        bits = 64 * min(map(len, rows[-1]))
        short = [np.unpackbits(ngram_join.parities(s, bits).view(np.uint8)) for s in (a, b)]
        want.append((int((short[0] != short[1]).sum()), n + m - 2 * common))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>").coalesce(1)
    got = [r[0] for r in df.select(ngram_join.differing("x", "y")).collect()]
    assert got == [w[0] for w in want] and all(g <= w[1] for g, w in zip(got, want))
    assert ngram_join.wide(np.zeros(1024, np.uint64)) is None and got[-1] * 185 > 6000 * 15
