"""Vector operators, sharding and classifiers against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import ann, neardup, quality, sharding, toxicity
from meridia.llm.common import Workspace, connected_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(rng, n=400, dim=16):
    centres = rng.normal(size=(60, dim))
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * 0.12
    x[n // 2 : n // 2 + 40] = x[0]  # copies
    return [(int(i), [float(v) for v in np.float32(row)], int(i) % 3) for i, row in enumerate(x)]


ODD = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0] * 15 + [None], 1), (1004, [1.0] * 16, None), (1005, [1.0] * 3, 1), (1006, [], 1), (None, [5.0] + [0.0] * 15, 2)]


@pytest.mark.parametrize("block", [4000, 7])
def test_near_duplicates(spark, block):
    rows = vectors(np.random.default_rng(2)) + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("v", F.lit(2))
    got = {r["vec_id"]: r for r in neardup.near_duplicates(spark, df, 0.93, pivots=32, block=block).collect()}
    assert len(got) == len(rows)
    links = found = 0
    comps = {}
    for label in range(3):
        part = [r for r in rows if r[2] == label and r[0] is not None and r[0] < 1000]
        x = np.array([r[1] for r in part])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T >= 0.93
        np.fill_diagonal(s, False)
        links += s.sum()
        for r, n in zip(part, s.sum(1)):
            found += got[r[0]]["n_links"]
            assert got[r[0]]["n_links"] <= n
        comps[label] = s
    assert found >= 0.98 * links > 0
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items() if i is not None)
    assert neardup.near_duplicates(spark, df.limit(0)).count() == 0


def test_nearest(spark):
    rows = vectors(np.random.default_rng(4), 600) + ODD
    df = spark.createDataFrame([r for r in rows if r[0] != 1004], SCHEMA)
    got = collections.defaultdict(list)
    for r in ann.nearest(spark, df, F.col("vec_id") % 20 == 0, block=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([r[1] for r in rows[:600]])
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(600), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)
    few = ann.nearest(spark, df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3]
    assert ann.nearest(spark, df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_in_a_cluster_of_near_copies(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 16))
    x[1000:3000] = x[0] + rng.normal(size=(2000, 16)) * 0.02  # near copies, that product codes cannot order
    x = np.float32(x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(float)
    for options in ({"cells": 8, "codes": 16}, {"cells": 32, "codes": 16, "probes": 3, "shortlist": 20}):
        got = collections.defaultdict(list)
        for r in ann.nearest(spark, df, F.col("vec_id") % 40 == 0, parts=4, block=1500, **options).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"]))
        assert sorted(got) == list(range(0, 4000, 40))
        for q, found in got.items():
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            assert [i for _, i in sorted(found)] == np.lexsort((np.arange(4000), d))[:10].tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(500, 560)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in list(root)}


def test_sharding(spark):
    rng = random.Random(6)
    texts = [f"text {i} " + "x" * rng.randint(0, 400) for i in range(3000)] + ["copy " * 30] * 900 + [None] * 5 + ["", "é"] * 4 + [f"pair {i // 2}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("n", F.lit(1))
    rows = sharding.shard(spark, df).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if t and t.startswith("pair"):
            where[t].add(r["shard"])
    assert len(size) == 16 and max(size.values()) < 1.03 * sum(size.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(w) > 1 for w in where.values()) <= 10  # hashing alone would part 94 of 100 pairs
    assert sharding.shard(spark, df.limit(0)).count() == 0


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["vilefoo", "vilebar", "nastyish"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity(spark):
    rows = corpus(random.Random(8), 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, ""), (5001, None), (5002, "vilequx " * 5 + "lone soul " * 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if i % 3 == 0]
    assert sum(a == b for a, b in held) > 0.98 * len(held)
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[5002]["predicted"] == 1  # by its stem
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(spark, docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0


def plain_ratios(docs, labels, z=3.0):
    """The class-conditional model by loops: continuation counts over different texts, discounts, shared backoff."""
    texts = {y: {docs[i] or "" for i, v in labels if v == y and i in docs} for y in (0, 1)}
    n = {y: len(t) for y, t in texts.items()}

    def expressions(text):
        w = re.findall(r"[^\W\d_]+", text.lower())
        return set(w) | {x[:k] + "*" for x in w for k in (4, 5, 6) if len(x) > k} | {" ".join(p) for p in zip(w, w[1:])}

    count = {y: collections.Counter(g for t in texts[y] for g in expressions(t)) for y in (0, 1)}
    share = collections.Counter(g for t in docs.values() for g in expressions(t or ""))
    out = {}
    for g in count[0].keys() | count[1].keys():
        p, kept = {}, 0
        for y in (0, 1):
            e = n[y] * share[g] / len(docs)
            left = max(0.0, count[y][g] - min(count[y][g], e + z * math.sqrt(e + 1)))
            p[y], kept = (left + e) / n[y], kept + left
        if kept:
            out[g] = math.log(p[1] / p[0])
    return out


def plain_ratio(ratios, text):
    w = re.findall(r"[^\W\d_]+", (text or "").lower())
    total = 0.0
    for v, x in zip([None, *w], w):
        total += next((ratios[g] for g in (f"{v} {x}", x, *(x[:k] + "*" for k in (6, 5, 4) if len(x) > k)) if g in ratios), 0.0)
    return total / len(w) if w else 0.0


def test_toxicity_equals_a_plain_model(spark):
    rows = corpus(random.Random(12), 500)
    rows += [(600 + i, "so very vilefoo indeed " * 3 + f"word{i}", 1) for i in range(12)] + [(700 + i, rows[i][1], rows[i][2]) for i in range(30)]
    texts = dict((i, t) for i, t, _ in rows) | {9000: None, 9001: "", 9002: "x " * 20_000}
    labels = [(i, y) for i, _, y in rows if i % 3] + [(9000, 0)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("toxic", F.lit(5)).withColumn("score", F.lit("s"))
    model = toxicity.train(spark, docs, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, toxic int, text int"))
    want = plain_ratios(texts, labels)
    assert model.ratios.keys() == want.keys() and any(" " in g for g in want) and any(g.endswith("*") for g in want)
    assert all(abs(model.ratios[g] - r) < 1e-9 for g, r in want.items())
    for r in toxicity.score(docs, model, keep=("doc_id", "score")).collect():
        z = model.weight * plain_ratio(want, texts[r["doc_id"]]) + model.constant
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_ordinal_gradient():
    """The gradient against differences, with words, shapes and shares, on four grades."""
    rng = np.random.default_rng(3)
    texts = ["alpha Beta 12 ***", "GAMMA gamma", "", "alpha alpha, 3", "delta\n\ndelta && x", "Beta beta beta 7"]
    rows, y = [quality.features(t) for t in texts], np.array([0, 1, 2, 3, 1, 2])
    m = quality.Ordinal([0, 1, 2, 3])
    m.w, m.first, m.gaps = rng.normal(size=quality.SIZE) * 0.1, -0.3, np.array([0.2, -0.4])
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col, val = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    ridge = np.full(quality.SIZE, 1e-3)
    loss = lambda: m.gradient(at, col, val, y, len(rows), ridge)[0]
    dw, dfirst, dgaps = m.gradient(at, col, val, y, len(rows), ridge)[1]
    eps = 1e-6
    words = [c for c in set(col.tolist()) if quality.SHAPES <= c < quality.SHAPES + quality.WORDS]
    assert len(words) >= 4  # words have weights of their own
    for c in [*words, int(col[0]), quality.SIZE - 1]:
        m.w[c] += eps
        up = loss()
        m.w[c] -= 2 * eps
        assert abs((up - loss()) / (2 * eps) - dw[c]) < 1e-6
        m.w[c] += eps
    m.first += eps
    up = loss()
    m.first -= 2 * eps
    assert abs((up - loss()) / (2 * eps) - dfirst[0]) < 1e-6
    m.first += eps
    for k in range(2):
        m.gaps[k] += eps
        up = loss()
        m.gaps[k] -= 2 * eps
        assert abs((up - loss()) / (2 * eps) - dgaps[k]) < 1e-6
        m.gaps[k] += eps


def test_quality_by_words_alone(spark):
    """Grades that depend on words and not on shapes, with clashing columns and repeated rows."""
    rng = random.Random(22)
    vocabulary = {0: ["mellow", "hollow", "shallow"], 1: ["fellow", "billow", "swallow"]}
    rows = [(i, " ".join(rng.choice(vocabulary[i % 2]) for _ in range(30)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]], "doc_id long, text string").withColumn("grade", F.lit(9)).withColumn("selected", F.lit("s"))
    model = quality.train(spark, docs, spark.createDataFrame([(i, g, "t") for i, _, g in rows if i % 5], "doc_id long, grade int, text string"))
    got = quality.score(docs, model, keep=("doc_id", "selected")).collect()
    assert len(got) == 401 and sum(r["selected"] == (r["doc_id"] % 2 == 1) for r in got) > 390


def test_ordinal_grades(spark):
    rng = random.Random(10)
    rows = []
    for i in range(900):
        grade = i % 4
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + (rng.choice(["***", "&&&"]) if rng.random() < 0.3 * (3 - grade) + 0.02 else "") for _ in range(60)]
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (5002, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 5], "doc_id long, grade int")
    model = quality.train(spark, docs, labels)
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs, model, least=2).collect()}
    held = [(g, got[i]["expected_grade"], got[i]["selected"]) for i, _, g in rows if i % 5 == 0]
    assert np.mean([abs(g - e) for g, e, _ in held]) < 0.35
    assert np.mean([(g >= 2) == s for g, _, s in held]) > 0.9
    assert all(0 <= got[i]["tail_probability"] <= 1 for i in (5000, 5001, 5002))
    assert quality.train(spark, docs, labels.where("grade = 1")) is None
    assert quality.score(docs, None).where("selected").count() == 903
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_keeps_words_in_two_generations(monkeypatch):
    """op7: words beyond the limit do not empty what is kept; ASCII texts have the same words by the shorter pattern."""
    monkeypatch.setattr(toxicity, "CACHE", 100)
    made = []
    kept = toxicity.Kept(lambda w: made.append(w) or len(w))
    for turn in range(20):
        names = [f"w{i}" for i in range(80)] + [f"rare{turn}-{i}" for i in range(10)]
        assert [kept[w] for w in names] == list(map(len, names))
    assert len(made) == len(set(made)) == 280 and len(kept) <= 100
    for text in ("It's 2 O'Clock, a_b c-d\tE1f", "", "Ünï cödé a1b_c"):
        assert toxicity.words(text) == toxicity._WORD.findall(text.lower())
    model = toxicity.Model({"bad": 1.0, "good bad": -2.0, "awful*": 0.5})
    assert model.ratio("bad good bad awfully") == (1.0 + 0.0 - 2.0 + 0.5) / 4


def test_known_terms_of_a_text():
    """Words and stems of a text that have evidence, each once, as a plain look at every word's terms gives them."""
    own = {"a", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh", "éééééé", "ééééééé"}
    for known in (set(), {"abcd", "abcd*", "abcde*", "abcdef*", "éééééé*", "zzzz*", "a", "b"}, own):
        got = toxicity.known_terms(own, known, toxicity.by_length(known))
        assert sorted(got) == sorted({g for x in own for g in (x, *toxicity.stems(x)) if g in known})
