"""Near-duplicate documents: order MinHash for candidates, banded alignment of five-word shingles to verify them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import components, cut, text_chunks
from ._words import mix, shingles_of, words

#: Least similarity of a link: shingles aligned in order over the shingles of both.
SIMILARITY = 0.8
#: Sketches of a document and occurrence-labelled shingles of a sketch. Two documents of similarity s share a sketch with
#: probability s**LEAST or so, hence miss all with (1 - s**LEAST)**SKETCHES: 4e-5 at 0.8.
SKETCHES, LEAST = 14, 3
#: Rows of one key beyond which the first passes deal a bucket over several tasks; the last one compares all its pairs.
HOT = 20_000
#: Documents of a side that one task compares in full, and the fewest and most bits of a parity map.
BLOCK, BITS = 2_048, (256, 16_384)
#: Sketches of the first pass, which puts most of a large group into one component before all others are gone through.
FIRST = 3

_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_STEP = np.uint64(0xA0761D6478BD642F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
SKETCH_SCHEMA = "row long, doc_id long, t long, n int, h1 long, h2 long, sketch array<long>"


def sketch_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, two hashes of the whole shingle sequence, order-MinHash sketches) of every text; zeros without a word."""
    w = words(texts)
    per = np.diff(w.first)
    n = np.where(per >= 5, per - 4, np.minimum(per, 1))
    h1, h2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    out = np.zeros((len(texts), SKETCHES), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return n, h1, h2, out
    sh = np.concatenate([shingles_of(w.hashes[w.first[d] : w.first[d + 1]]) for d in some])
    size = n[some]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    doc = np.repeat(np.arange(len(some)), size)
    place = (np.arange(len(sh)) - first[doc]).astype(np.uint64)
    h1[some] = np.add.reduceat(mix(sh + place * _STEP), first)
    h2[some] = np.add.reduceat(mix((sh ^ _STEP) + place * _SEEDS[0]), first)
    order = np.lexsort((sh, doc))  # stable: equal shingles stay in text order
    s, d = sh[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    run = np.flatnonzero(new)
    times = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
    label = np.empty(len(s), np.uint64)
    label[order] = mix(s + times.astype(np.uint64) * _STEP)
    for i, seed in enumerate(_SEEDS):
        v = mix(label ^ seed)
        at = np.full((len(some), LEAST), np.iinfo(np.int64).max)
        for k in range(LEAST):
            least = np.minimum.reduceat(v, first)
            hit = np.flatnonzero((v == least[doc]) & (v != _TOP))
            at[doc[hit], k] = hit
            v[hit] = _TOP
        at.sort(axis=1)  # text order
        code = np.full(len(some), i + 1, np.uint64)
        for k in range(LEAST):
            have = at[:, k] < len(label)
            code = np.where(have, mix(code * _STEP + label[np.minimum(at[:, k], len(label) - 1)]), code)
        out[some, i] = code
    return n, h1, h2, out


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(3)):
                n, h1, h2, sketch = sketch_texts(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, SKETCHES), pa.int32()), pa.array(sketch.ravel().view(np.int64)))
                cols = [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "t", "n", "h1", "h2", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SKETCH_SCHEMA)


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(key, doc, n, root, links) -> pairs (a, b), a < b, of different roots and like length, as many as rows times a constant.

    By bands of length, most ``links`` first, a document meets the first of its band and of the band before, and its
    predecessor: stars around the documents that most others are like, and a chain. Rows are sorted by Spark and streamed, so
    a key of any size needs constant memory; keys of over HOT rows are dealt over tasks by a salt. This only joins most of a
    group cheaply: what it leaves apart is compared by ``all_pairs``.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    size = size.where("low <> high").select("key", "size")
    salt = F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / HOT))
    band = F.floor(F.log("n") / np.log(1 / SIMILARITY))
    dealt = rows.join(size, "key").withColumn("salt", salt).repartition("key", "salt").withColumn("band", band).withColumn("turn", F.xxhash64("doc"))
    dealt = dealt.sortWithinPartitions("key", "salt", "band", F.desc("links"), "turn", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band, last, leader, before = None, None, None, None, None
        for batch in batches:
            left, right = [], []
            for key, salt, doc, n, root, own in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group != (key, salt):
                    group, band, last, leader, before = (key, salt), own, None, None, None
                elif band != own:
                    band, leader, before = own, None, leader if band == own - 1 else None
                for d, m, r in {last, leader, before} - {None}:
                    if r != root and d != doc and min(n, m) >= SIMILARITY * max(n, m):
                        left.append(min(d, doc))
                        right.append(max(d, doc))
                last = (doc, n, root)
                leader = leader or last
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.select("key", "salt", "doc", "n", "root", "band").mapInArrow(run, "a long, b long").distinct()


def parity_map(sh: np.ndarray) -> np.ndarray:
    """Whether each of 2**k bins (about one a shingle) holds an odd number of the shingles, as words of 64 bits. Two maps differ
    in at most as many bins as the texts have unmatched shingles, also after both are folded to fewer bins by ``halved``."""
    k = min(max(int(len(sh) - 1).bit_length(), BITS[0].bit_length() - 1), BITS[1].bit_length() - 1)
    odd = np.bincount((mix(sh) >> np.uint64(40)).astype(np.int64) & ((1 << k) - 1), minlength=1 << k) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def halved(maps: np.ndarray, width: int) -> np.ndarray:
    """Parity maps (one a row) folded to ``width`` words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def open_pairs(doc: np.ndarray, n: np.ndarray, root: np.ndarray, maps: list[bytes], side: np.ndarray, both: bool, sketch: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (smaller id, larger id) of different roots that may be alike, between the first side and the second if ``both``,
    else among all. Only pairs that ``aligned`` would refuse are left out: by length, or by more bins of different parity than
    two texts that alike have unmatched shingles; and pairs whose first common sketch isn't that at ``place``, as they meet in
    its bucket."""
    left, right = [], []
    order = np.argsort(n, kind="stable")
    doc, n, root, side, sketch = doc[order], n[order], root[order], side[order], sketch[order]
    width = np.array([len(maps[i]) // 8 for i in order])
    end = np.searchsorted(n, np.floor(n / SIMILARITY + 1e-9), "right")
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        low, high = some[0], int(end[some].max())
        m = np.empty((high - low, w), np.uint64)  # all wider maps in reach, folded; widths grow with n
        for v in np.unique(width[low:high]):
            at = np.flatnonzero(width[low:high] == v)
            m[at] = halved(np.frombuffer(b"".join(maps[order[low + i]] for i in at), np.uint64).reshape(len(at), v), int(w))
        for i in some:
            j = np.arange(i + 1, end[i])
            j = j[(root[j] != root[i]) & (doc[j] != doc[i])]
            if both:
                j = j[side[j] != side[i]]
            if not len(j):
                continue
            total = n[i] + n[j]
            slack = total - 2 * np.ceil(SIMILARITY / (1 + SIMILARITY) * total - 1e-9)
            j = j[np.bitwise_count(m[j - low] ^ m[i - low]).sum(axis=1, dtype=np.int64) <= slack]
            j = j[(sketch[j] == sketch[i]).argmax(axis=1) == place]
            left.append(np.minimum(doc[i], doc[j]))
            right.append(np.maximum(doc[i], doc[j]))
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def all_pairs(rows: DataFrame, shingles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, place, doc, n, root) -> every pair (a, b), a < b, of one key and of different roots that can be alike, once.
    ``nodes`` (node, sketch) has the sketches of the documents, of which ``key`` is that at ``place``.

    Nothing is skipped but what has one root already or can't reach SIMILARITY. The rows of a key's most common root needn't
    meet each other. Both they and the others are dealt into blocks of about BLOCK documents, and a task compares two
    blocks, so that a key of any size is spread over tasks that each hold two blocks.
    """
    many = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    many = many.groupBy("key").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max(F.struct("c", "root"))["root"].alias("main")).where("size > most")
    rows = cut(rows.join(many, "key"), "open")
    rest = F.col("size") - F.col("most")
    others, mains = F.ceil(rest / BLOCK), F.ceil(F.col("most") / BLOCK)
    is_main = F.col("root") == F.col("main")
    block = F.pmod(F.xxhash64("doc"), F.when(is_main, mains).otherwise(others))
    # units (x, y) with x <= y of blocks of others, and (x, -1 - y) of a block of others and one of the main root
    own = F.transform(F.sequence(F.lit(0).cast("long"), others - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y"), (block > o).cast("int").alias("side")))
    cross = F.transform(F.sequence(F.lit(0).cast("long"), mains - 1), lambda o: F.struct(block.alias("x"), (-1 - o).alias("y"), F.lit(0).alias("side")))
    mine = F.transform(F.sequence(F.lit(0).cast("long"), others - 1), lambda o: F.struct(o.alias("x"), (-1 - block).alias("y"), F.lit(1).alias("side")))
    dealt = rows.select("key", "place", "doc", "n", "root", F.explode(F.when(is_main, mine).otherwise(F.concat(own, cross))).alias("u"))

    def map_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [parity_map(np.frombuffer(x.as_py(), np.uint64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["doc", "map"])

    maps = cut(shingles.join(rows.select(F.col("doc").alias("node")).distinct(), "node", "left_semi").mapInArrow(map_of, "doc long, map binary").join(nodes.select(F.col("node").alias("doc"), "sketch"), "doc"), "maps")
    dealt = dealt.join(maps, "doc").select("key", "u.x", "u.y", "u.side", "doc", "n", "root", "place", "map", "sketch")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(part: pa.Table) -> pa.RecordBatch:
            key, x, y, side, doc, n, root, place = (part.column(i).to_numpy() for i in range(8))
            maps = part.column(8).to_pylist()
            sketch = part.column(9).combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            begin = np.flatnonzero(new)
            found = [open_pairs(doc[a:b], n[a:b].astype(np.int64), root[a:b], maps[a:b], side[a:b], bool(x[a] != y[a]), sketch[a:b], int(place[a])) for a, b in zip(begin, np.append(begin[1:], len(key)))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.num_rows  # the last unit may go on in the next batch
            unit = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            same = np.logical_and.reduce([u == u[-1] for u in unit])
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if held and (at or any(held[-1].column(i)[held[-1].num_rows - 1].as_py() != u[0] for i, u in enumerate(unit))):
                yield pairs_of(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield pairs_of(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether M / (len(a) + len(b) - M) >= least for M, the longest common subsequence of two shingle sequences.

    An alignment that good leaves at most ``slack`` shingles of both unmatched, so it lies in a band of that width around
    the diagonal; the programme over the band is kept as bits of integers, a row at a time.
    """
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    one, two = Counter(a.tolist()), Counter(b.tolist())
    if sum((one & two).values()) < need:
        return False
    where = {s: i for i, s in enumerate(b.tolist()) if two[s] == 1}
    tails: list[int] = []
    for s in a.tolist():  # shingles that occur once in both: the longest run of them in order is a lower bound
        if one[s] == 1 and (j := where.get(s)) is not None:
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
    if len(tails) >= need:
        return True
    slack = len(a) + len(b) - 2 * need
    match: dict[int, int] = {}
    for j, s in enumerate(b.tolist()):
        match[s] = match.get(s, 0) | 1 << j
    full, width = (1 << len(b)) - 1, (1 << 2 * slack + 1) - 1
    v = full
    for i, s in enumerate(a.tolist()):
        band = width << (i - slack) if i > slack else width >> (slack - i)
        u = v & match.get(s, 0) & band
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count() >= need


def text_key() -> list[Column]:
    """(doc_id, t): what a row's node is found by; rows with both alike are copies."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t")]


def shingle_rows(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sh): the shingles of the texts that ``nodes`` (node, doc_id, t) name, each once."""
    texts = docs.select(*text_key(), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in text_chunks(batch.column(1)):
                w = words(some)
                sh = [shingles_of(w.hashes[w.of(d)]).tobytes() for d in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sh, pa.binary())], names=["node", "sh"])

    # a plan that doesn't depend on how few nodes there are: their side is built, the texts aren't sorted
    made = texts.join(nodes.hint("shuffle_hash"), ["doc_id", "t"]).select("node", "text").mapInArrow(run, "node long, sh binary")
    return made.groupBy("node").agg(F.first("sh").alias("sh"))


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose shingles align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [aligned(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(shingles.select(F.col("node").alias("a"), F.col("sh").alias("sh_a")), "a").join(shingles.select(F.col("node").alias("b"), F.col("sh").alias("sh_b")), "b")
    return both.select("a", "b", "sh_a", "sh_b").mapInArrow(run, "a long, b long")


def nearest_root(links: DataFrame) -> DataFrame:
    """(id, root, links): the smallest document linked to each, or rather that one's smallest, and how many are linked. Equal
    roots mean one component; a component may still have several."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("links")), "roots")
    return one.join(one.select(F.col("a").alias("m"), F.col("m").alias("root")), "m").select(F.col("a").alias("id"), "root", "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, t, class_id (smallest doc_id that links reach), kept.

    A link joins two texts of which the five-word shingles align in order with similarity SIMILARITY or more. Texts with
    equal words are one node from the start, so copies are never paired. Candidates share a sketch: first the nodes of a
    bucket meet a few others, then all pairs of a bucket that aren't known to be connected are compared, but for those that
    can't be alike; so any two alike texts that share a sketch are in one class. ``row`` numbers the rows in the table that is
    written first, ``t`` is a hash of the text.

    Exactly one row of a class is kept: that of the smallest doc_id, of repeated rows the first. Rows that share a doc_id but
    not their words are nodes of their own. A text without any word (null, empty, punctuation) is its own class. Rows with a
    null doc_id are their own class and kept. Texts of one to four words are one shingle. Other columns are ignored. An empty
    table gives no row.
    """
    made = cut(sketches(docs), "sketches")
    known = made.where("n > 0 and doc_id is not null")
    same = known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "t", "n", "sketch")).alias("x"))
    same = cut(same.select("h1", "h2", F.col("x.row").alias("node"), "x.doc_id", "x.t", "x.n", "x.sketch"), "nodes")
    buckets = same.select(F.posexplode("sketch").alias("place", "key"), F.col("node").alias("doc"), "n")
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(buckets.join(shared, "key").select("key", "place", "doc", "n"), "buckets")
    used = buckets.select(F.col("doc").alias("node")).distinct()
    shingles = cut(shingle_rows(docs, same.join(used, "node", "left_semi").select("node", "doc_id", "t")), "shingles")

    first = buckets.where(F.col("place") < FIRST).select("key", "doc", "n", F.col("doc").alias("root"), F.lit(1).cast("long").alias("links"))
    pairs = cut(verified(bucket_pairs(first), shingles), "links")
    rows = buckets.join(nearest_root(pairs), F.col("doc") == F.col("id"), "left").select("key", "doc", "n", F.coalesce("root", "doc").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    roots = cut(components(pairs.unionByName(cut(verified(bucket_pairs(rows), shingles), "links"))), "roots")
    rows = buckets.join(roots, F.col("doc") == F.col("id"), "left").select("key", "place", "doc", "n", F.coalesce("root", "doc").alias("root"))
    more = cut(verified(all_pairs(rows, shingles, same.select("node", "sketch")), shingles), "links")
    # components of the components
    more = more.join(roots.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b", "left")
    joined = components(more.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("top"))
    top = roots.join(joined, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    single = joined.join(roots.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("top").alias("root"))
    roots = cut(top.unionByName(single).join(same.select(F.col("node").alias("id"), "doc_id"), "id"), "members")
    best = roots.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("best"))
    linked = roots.join(best, "root").select(F.col("id").alias("node"), F.col("best.doc_id").alias("class_id"), F.col("best.id").alias("chosen"))

    found = known.select("row", "doc_id", "t", "h1", "h2").join(same.select("h1", "h2", "node", F.col("doc_id").alias("least")), ["h1", "h2"]).join(linked, "node", "left")
    found = found.select("row", "doc_id", "t", F.coalesce("class_id", "least").alias("class_id"), (F.col("row") == F.coalesce("chosen", "node")).alias("kept"))
    alone = made.where("n = 0 or doc_id is null").select("row", "doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep. Rows are found again by doc_id and text, not by their place
    in a scan, which may differ from one to the next; of rows that agree in both one stays, whichever its other columns."""
    by = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id", "t").agg(F.count("*").alias("all"), F.sum(F.col("kept").cast("long")).alias("stay"))
    by = by.where("stay > 0").select("doc_id", "t", (F.col("stay") < F.col("all")).alias("many"))
    rows = docs.select(*text_key(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    kept = rows.join(by, ["doc_id", "t"])
    out = kept.where("not many").select("whole").unionByName(kept.where("many").dropDuplicates(["doc_id", "t"]).select("whole"))
    return out.unionByName(rows.where("doc_id is null").select("whole")).select("whole.*")
