"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into
fragments (as many as suit a document's size class, a power of two), so that a
document's set falls into segments, one per fragment.

Candidates. Two sets with Jaccard similarity t or more differ in at most
``d = (1 - t) / t * size`` n-grams, so among the first ``d + 1`` fragments that
are not empty, at least one holds the same n-grams in both. Each document
emits that many segment hashes (in the neighbouring size class as well, where a
partner could be in it), and documents that share one are candidates. A segment
of several n-grams is far rarer than an n-gram, so passages that many documents
share do not make long lists.

Verification. A sketch of the parities of a set's n-grams in 1024 fragments
bounds from below in how many n-grams two sets differ, and rules out most
chance candidates. Two sets of more n-grams than that may differ in more than
1024 fragments can tell: they have a second sketch, with a bit or two for each
n-gram, which pairs that the first one leaves meet. For the others partial
overlaps are counted fragment by fragment and summed per pair.

Lists of up to ``direct`` documents give all their pairs. A longer one first
gives a chain and a star, which connect groups of copies with a number of pairs
linear in their size; if its documents are then in one component, it is done.
The others are common passages: their signatures are put behind all others in
the order, and the documents in them emit anew. A link that is still to be
found has its first common signature in such a list, so both its documents are
among those of the lists that are open after the last round.

Those few documents are compared by single n-grams. One that stands in one
component only cannot be part of a link that matters; of the others, the open
ones, rare ones come first, and two documents that link share one among the
first ``open - t * size + 1`` of both. Documents of the same open n-grams and
size have the same links and are compared once. What hangs together by those
n-grams is compared in blocks of bounded size: partial overlaps are counted in
one fragment of the order after another and summed, and a block gives a spanning
forest of its links. Components are exact, and no group's pairs are written out.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, forest, slices
from .tokens import distinct

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n following word hashes."""
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = mixed(h * _MUL + w[i : len(w) - n + 1 + i] + np.uint64(i + 1))
    return h


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct n-grams of ASCII-lower-cased words; of the whole sequence where it is shorter."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    codes, bounds, words = distinct(split)
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    full = np.array([bool(w) for w in words])[codes]  # a blank at an end leaves an empty word
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    hashes = pd.util.hash_array(np.array(words, object), categorize=False).astype(np.uint64)
    w = hashes[codes[full]]
    rolled = _rolled(w, n) if len(w) >= n else w[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        else:
            out.append(_rolled(w[a:b], b - a) if b > a else w[:0])
    return out


def segments(s: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the segments that are not empty, in order, of 2**level fragments."""
    frag = s >> np.uint64(64 - level)
    starts = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
    sums = np.add.reduceat(mixed(s + _MUL), starts)
    return mixed(sums ^ mixed(frag[starts] * np.uint64(64) + np.uint64(level))).view(np.int64)


def signatures(s: np.ndarray, num: int, den: int, late: np.ndarray) -> np.ndarray:
    """What a set emits, of both size classes; signatures in ``late`` (sorted) come after all others, by value."""
    k = len(s)
    if not k:
        return np.zeros(0, np.int64)
    most = (den - num) * k // num + 1
    out = []
    for level in {level_of(k, num, den), level_of(-(-k * num // den), num, den)}:  # own, and that of the smallest partner
        g = segments(s, level)
        if len(late):
            at = np.searchsorted(late, g)
            is_late = late[np.minimum(at, len(late) - 1)] == g
            g = np.concatenate([g[~is_late], np.sort(g[is_late])])
        out.append(g[:most])
    return np.concatenate(out)


FINEST = 60


def level_of(size: int, num: int, den: int) -> int:
    """Fragments by size class: a power of two that is clearly over the n-grams in which partners may differ.

    With 32 fragments or more, the chance that a set fills so few of them that
    no equal one is guaranteed is below that of a hash collision; smaller sets
    have fragments of single n-grams, which always suffice.
    """
    level = int(np.ceil(np.log2(1.6 * ((den - num) * size // num) + 2)))
    return level if level >= 5 else FINEST


SKETCH = 1024


def parities(s: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """So many bits (a power of two), as longs: whether a fragment holds an odd number of n-grams. Each differing n-gram flips one."""
    odd = (np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide(s: np.ndarray) -> np.ndarray | None:
    """The second sketch of a set that is larger than the first: at least a bit for each n-gram."""
    return parities(s, 1 << (len(s) - 1).bit_length()) if len(s) > SKETCH else None


def differing(x: str, y: str) -> F.Column:
    """Bits in which two sketches differ; the halves of a longer one are added until it is as short as the other."""
    n = f"least(size({x}), size({y}))"
    short = lambda c: f"aggregate(sequence(0, cast(size({c}) / {n} as int) - 1), 0L, (s, j) -> s ^ {c}[j * {n} + i])"
    return F.expr(f"aggregate(sequence(0, {n} - 1), 0, (d, i) -> d + bit_count({short(x)} ^ {short(y)}))")


def _pairs(sig: np.ndarray, doc: np.ndarray, size: np.ndarray, num: int, den: int, direct: int, head: int | None = None):
    """(pairs a, b; long lists sig, doc, size) among rows that share a signature.

    Rows are in the order of signature, size and document. With ``head`` the
    first rows go on with a long list: row 0 is its smallest document, row 1 the
    last one that was seen, and ``head`` how many rows belong to it.
    """
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
    count = np.diff(np.append(first, len(sig)))
    long = count > direct
    if head:
        long[0] = True
    small = (count > 1) & ~long
    at = np.repeat(first, count)
    n = np.repeat(count, count)
    rows = np.arange(len(sig))
    a, b = [], []
    within = np.repeat(small, count)
    for step in range(1, direct):
        i = rows[within & (rows - at + step < n)]
        a.append(i)
        b.append(i + step)
    large = np.repeat(long, count)
    i = rows[large]
    for other in (i - 1, at[i]):  # chain by size, star from the smallest
        a.append(i)
        b.append(np.maximum(other, at[i]))
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
    lo, hi = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
    fits = (lo != hi) & (np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num)
    both = np.unique(np.stack([lo[fits], hi[fits]], 1), axis=0) if fits.any() else np.zeros((0, 2), np.int64)
    if head:
        large[:2] = False  # they were listed before
    return both, (sig[large], doc[large], size[large])


def paired(rows, num: int, den: int, direct: int):
    """``_pairs`` of parts (sig, doc, size) of one sorted sequence. Of a list only its first rows are held, however long it is."""
    held, head = [np.zeros(0, np.int64)] * 3, None
    for part in rows:
        sig, doc, size = (np.concatenate(x) for x in zip(held, part))
        if head is not None:
            head = int(np.searchsorted(sig, sig[0], side="right"))
        first = int(np.searchsorted(sig, sig[-1]))
        long = len(sig) - first > direct or (head is not None and first == 0)
        if long:  # the last list goes on as its smallest and its last row
            yield _pairs(sig, doc, size, num, den, direct, head)
            held, head = [x[[first, -1]] for x in (sig, doc, size)], 2
        else:
            if first:
                yield _pairs(sig[:first], doc[:first], size[:first], num, den, direct, head)
            held, head = [x[first:] for x in (sig, doc, size)], None
    if len(held[0]) and head is None:
        yield _pairs(*held, num, den, direct)


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Rows link when ``100 * intersection >= percent * union``. Null and empty
    texts, and texts of white space, have no n-grams and link with nothing; so
    do rows with a null id. Repeated rows and copies are merged first and are
    in one component. An id with different texts is one document that links by
    each of them: every text is compared. Texts of any length are compared
    whole. An empty table gives no rows; other columns are ignored.

    Options: ``direct``, ``rounds``; ``send_ids``, up to which ids that choose
    the texts to be read again are broadcast (8 MB; more are joined by a
    shuffle) and signatures are put late; ``hot``, the length from which a list
    is connected by a join and not in one task. None of them changes results.
    """
    ws = Workspace(spark, "ngram")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = src.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if not named.where("n > 1").limit(1).count():
        return _components(ws, src, n, percent, **options)
    # each row by itself, then ids that share a component
    each = ws.stage(src.withColumn("own", F.monotonically_increasing_id()), "each")
    found = ws.stage(_components(ws, each.select(F.col("own").alias("doc_id"), "text"), n, percent, **options).toDF("own", "n_shingles", "star"), "found")
    rows = ws.stage(each.select("doc_id", "own").join(found, "own"), "joined")
    low = rows.where("doc_id is not null").groupBy("star").agg(F.min("doc_id").alias("low"))
    same = connected_components(ws, rows.join(low, "star").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    out = rows.join(same.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _components(ws: Workspace, src: DataFrame, n: int, percent: int, direct: int = 8, rounds: int = 2, send_ids: int = 1_000_000, hot: int = 50_000) -> DataFrame:
    """``near_duplicates`` of (doc_id, text), where no id that is not null is repeated."""
    spark = ws.spark
    num, den = percent, 100
    none = np.zeros(0, np.int64)
    longs = pa.list_(pa.int64())

    def described(rows: DataFrame, late: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast(late)

        def run(batches):
            for batch in slices(batches, 1):
                ids, sets = batch.column(0), shingles(batch.column(1), n)
                keys = [[int(mixed(s).sum().view(np.int64)) if len(s) else None for s in sets], [int(mixed(s ^ _MUL).sum().view(np.int64)) if len(s) else None for s in sets]]
                sigs = [signatures(s, num, den, held.value) for s in sets]
                cols = [ids, pa.array([len(s) for s in sets], pa.int64()), *[pa.array(k, pa.int64()) for k in keys], pa.array(sigs, longs), *[pa.array([f(s) for s in sets], longs) for f in (parities, wide)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "key_1", "key_2", "sigs", "odd", "wide"])

        return rows.mapInArrow(run, "doc_id long, n_shingles long, key_1 long, key_2 long, sigs array<long>, odd array<long>, wide array<long>")

    def chosen(ids: DataFrame) -> DataFrame:
        """The texts of these ids."""
        return src.join(F.broadcast(ids) if ids.count() <= send_ids else ids, "doc_id", "left_semi")

    fits = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num

    def matched(reps: DataFrame) -> DataFrame:
        """Rows (a, b) of candidate pairs, and (a, null, sig, size) of long lists."""

        def run(batches):
            names = ["a", "b", "sig", "size"]
            parts = ([b.column(c).to_numpy() for c in ("sig", "doc_id", "n_shingles")] for b in batches if b.num_rows)
            for both, (ls, ld, lz) in paired(parts, num, den, direct):
                zero = np.zeros(len(both), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[:, 0], both[:, 1], zero, zero)], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(ld), pa.nulls(len(ld), pa.int64()), pa.array(ls), pa.array(lz)], names=names)

        posted = reps.select("doc_id", "n_shingles", F.explode("sigs").alias("sig"))
        # a sample says where long lists are; it decides where they are connected, not what is compared
        busy = posted.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > hot / 64).select("sig")
        busy = ws.stage(busy, "busy")
        rest, connected = posted, None
        if busy.limit(1).count():
            rest, many = posted.join(busy, "sig", "left_anti"), posted.join(busy, "sig", "left_semi")
            low = many.groupBy("sig").agg(F.min(F.struct("n_shingles", "doc_id")).alias("low"))
            star = many.join(low, "sig").withColumn("other", F.col("low.doc_id"))
            pairs = star.where((F.col("other") != F.col("doc_id")) & fits(F.col("n_shingles"), F.col("low.n_shingles")))
            zero = F.lit(0).cast("long")
            pairs = pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"), zero.alias("sig"), zero.alias("size"))
            connected = pairs.unionByName(many.select(F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "sig", F.col("n_shingles").alias("size")))
        lists = rest.repartition("sig").sortWithinPartitions("sig", "n_shingles", "doc_id").mapInArrow(run, "a long, b long, sig long, size long")
        return ws.stage(lists.unionByName(connected) if connected is not None else lists, "met")

    def distinct_pairs(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b")

    def cut(batches):
        for batch in slices(batches, 1):
            docs, frags, segs = [], [], []
            for d, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1), n)):
                ends = np.searchsorted(s, np.array([1 << 62, 2 << 62, 3 << 62], np.uint64))
                for f, part in enumerate(np.split(s, ends)):
                    docs.append(d)
                    frags.append(f)
                    segs.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(frags, pa.int32()), pa.array(segs, pa.binary())], names=["doc", "frag", "seg"])

    def overlaps(batches):
        for b in batches:
            got = []
            for x, y in zip(b.column("seg_a").to_pylist(), b.column("seg_b").to_pylist()):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                got.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got, pa.int64())], names=["a", "b", "common"])

    rows = ws.stage(described(src, none), "rows")
    classes = rows.where("key_1 is not null and doc_id is not null").groupBy("key_1", "key_2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = ws.stage(classes, "classes")
    names = classes.select(F.col("rep").alias("doc_id"))
    sketches = ws.stage(rows.join(names, "doc_id", "left_semi").select("doc_id", "n_shingles", "odd", "wide"), "sketches")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs with their sizes that their sketches do not rule out."""
        first, second = sketches.select("doc_id", "n_shingles", "odd"), sketches.where("wide is not null").select("doc_id", "wide")
        few = lambda differ: differ * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num)
        both = pairs.join(first.toDF("a", "size_a", "odd_a"), "a").join(first.toDF("b", "size_b", "odd_b"), "b")
        differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
        left = both.where(few(differ)).select("a", "b", "size_a", "size_b")
        left = left.join(second.toDF("a", "wide_a"), "a", "left").join(second.toDF("b", "wide_b"), "b", "left")
        return left.where(F.col("wide_a").isNull() | F.col("wide_b").isNull() | few(differing("wide_a", "wide_b"))).select("a", "b", "size_a", "size_b")

    links_by = lambda common: common * (den + num) >= (F.col("size_a") + F.col("size_b")) * num

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link: overlaps of four fragments, counted separately and summed."""
        involved = ws.stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
        seg = ws.stage(chosen(involved).mapInArrow(cut, "doc long, frag int, seg binary"), "segments")
        each = pairs.select("a", "b").withColumn("frag", F.explode(F.array(*map(F.lit, range(4)))))
        side = lambda c: seg.select(F.col("doc").alias(c), "frag", F.col("seg").alias(f"seg_{c}"))
        parts = each.join(side("b"), ["b", "frag"]).join(side("a"), ["a", "frag"]).select("a", "b", "seg_a", "seg_b")
        sums = parts.mapInArrow(overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
        links = ws.stage(sums.join(pairs, ["a", "b"]).where(links_by(F.col("common"))).select("a", "b"), "links")
        ws.drop(seg, involved)
        return links

    def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components with more links: those so far are stars, and what is new is linked to them."""
        if comp is not None and not links.limit(1).count():
            return comp
        edges = links if comp is None else links.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return ws.stage(connected_components(ws, edges), "components")

    def listed(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingles(batch.column(1), n)], longs)], names=["node", "grams"])

    def blocks(t: pa.Table) -> pa.Table:
        """A spanning forest of the links among the rows of one or two blocks: overlaps are counted in fragments of the n-grams that rows share, and summed."""
        rep, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
        lists = t.column("o").combine_chunks()
        row = np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy()))
        grams, at, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        rank = np.cumsum(times > 1) - 1
        shared = times[at] > 1
        row, col = row[shared], rank[at[shared]]
        left, right = (np.flatnonzero(t.column("mine").to_numpy() == t.column(side)[0].as_py()) for side in "ij")
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
            a, b = np.searchsorted(col, [start, start + 2048])
            part = np.zeros((len(rep), 2048), np.float32)
            part[row[a:b], col[a:b] - start] = 1
            common += part[left] @ part[right].T
        both = size[left][:, None] + size[right][None, :]
        a, b = np.nonzero((common.astype(np.int64) * (den + num) >= both * num) & (rep[left][:, None] != rep[right][None, :]))
        root = forest(len(rep), left[a], right[b])
        on = root != np.arange(len(rep))
        return pa.table([rep[root[on]], rep[on]], names=["a", "b"])

    def across(nodes: DataFrame) -> DataFrame:
        """Links that join the components of the nodes (node, size, component) further, by their open n-grams."""
        sets = chosen(nodes.select(F.col("node").alias("doc_id"))).mapInArrow(listed, "node long, grams array<long>")
        grams = ws.stage(sets.join(nodes, "node").select("node", "size", "component", F.explode("grams").alias("gram")), "grams")
        open_grams = grams.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("gram", "df")
        held = grams.join(open_grams, "gram").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("o"))
        held = held.withColumn("o", F.transform("o", lambda x: x["gram"])).where(F.size("o") * den >= F.col("size") * num)
        held = ws.stage(held.select("node", "size", F.xxhash64("o").alias("h1"), F.hash("o").alias("h2"), "o"), "held")
        ws.drop(grams)
        kinds = held.groupBy("h1", "h2", "size").agg(F.min(F.struct("node", "o")).alias("first"))
        kinds = ws.stage(kinds.select("h1", "h2", "size", F.col("first.node").alias("rep"), F.col("first.o").alias("o")), "kinds")
        many = F.size("o")
        first = many - F.ceil(F.col("size") * num / den).cast("int") + 1
        # only kinds that hang together by n-grams of their prefixes can link; each such group is cut into size classes and blocks
        posted = kinds.select("rep", F.explode(F.slice("o", F.lit(1), first)).alias("gram"))
        low = posted.groupBy("gram").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").select("gram", "low")
        group = connected_components(ws, posted.join(low, "gram").select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
        step = float(np.log(den / num)) * 1.000001
        of = kinds.select("rep", "size", "o").join(group, "rep").withColumn("own", F.floor(F.log("size") / step).cast("int"))
        of = of.select("rep", "size", "o", "component", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("level"), "own")  # a partner is in the same class or the next
        cells = of.groupBy("component", "level").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        cells = cells.select("component", "level", F.greatest(F.ceil(F.col("n") / 512), F.ceil(F.col("s") / 400_000)).cast("int").alias("blocks"))
        of = of.join(cells, ["component", "level"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        of = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tasks = of.select("component", "level", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "size", "o")
        found = ws.stage(tasks.groupBy("component", "level", "i", "j").applyInArrow(blocks, "a long, b long"), "blocks")
        # all of a kind link with what one of them links with, and with each other if they share enough
        partner = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).withColumnRenamed("a", "rep")
        member = held.join(kinds.select("h1", "h2", "size", "rep", F.size("o").alias("n")), ["h1", "h2", "size"])
        own = member.where((F.col("node") != F.col("rep")) & (F.col("n") * (den + num) >= F.col("size") * 2 * num)).select(F.col("node").alias("a"), F.col("rep").alias("b"))
        others = member.join(partner, "rep").select(F.col("node").alias("a"), "b")
        return ws.stage(found.unionByName(own).unionByName(others), "across")

    reps = rows.join(names, "doc_id", "left_semi").select("doc_id", "n_shingles", "sigs")
    tested, late, comp = [], none, None
    for turn in range(rounds + 1):
        met = matched(reps)
        pairs = distinct_pairs(met.where("b is not null"))
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        tested.append(ws.stage(pairs, "pairs"))
        comp = joined(comp, verified(ws.stage(plausible(tested[-1]), "plausible")))
        lists = met.where("b is null").select("sig", "size", F.col("a").alias("node"))
        named = lists.join(comp, "node", "left").select("sig", "size", "node", F.coalesce("component", "node").alias("component"))
        open_sigs = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
        left = ws.stage(named.join(ws.stage(open_sigs, "open"), "sig", "left_semi"), "left")
        ws.drop(met)
        fresh = left.select("sig").distinct()
        n_open = fresh.count()
        if not n_open:
            break
        if turn == rounds or len(late) + n_open > send_ids:
            comp = joined(comp, across(ws.stage(left.select("node", "size", "component").distinct(), "last")))
            break
        late = np.unique(np.concatenate([late, fresh.toArrow().column("sig").to_numpy()]).astype(np.int64))  # at most send_ids
        touched = ws.stage(left.select(F.col("node").alias("doc_id")).distinct(), "touched")
        reps = ws.stage(described(chosen(touched), late).select("doc_id", "n_shingles", "sigs"), "again")
    known = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key_1", "key_2", "n_shingles", F.coalesce("component", "rep").alias("c"))
    out = rows.join(ws.stage(known, "known"), ["key_1", "key_2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents whose id is their component's smallest, rows with a null id, and of each repeated id the row that sorts first."""
    found = near_duplicates(spark, docs, doc_id=doc_id, **options)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.join(kept, doc_id, "left_semi")
    if docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rest = [c for c in docs.columns if c != doc_id]
        named = named.groupBy(doc_id).agg(F.min(F.struct(*rest)).alias("first")).select(doc_id, "first.*").select(*docs.columns)
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
