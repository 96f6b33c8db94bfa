"""Titles joined by similarity: indexes that every similar pair meets in, by segments with an error or rare grams, then the exact ratio."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..tables import cut

#: Characters up to which texts are looked for by segments; longer ones by their rarest bigrams.
LONG = 256
#: Characters of the texts whose keys are made at once, and texts of a task at most, where there are many.
_CHARS, _TASK = 1 << 14, 10_000
_EPS = 1e-9
_BASE, _TAG = 0x9E3779B97F4A7C15, 0xA24BAED4963EE407
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(LONG + 2)], np.uint64)


def _apart(n: int, m: int, least: float) -> int:
    """Characters of two texts of n and m characters that are unmatched at most."""
    return math.floor((1 - least) * (n + m) + _EPS)


def _unmatched(n: int, least: float) -> int:
    """The same with a partner of any length."""
    return _apart(n, math.floor(n * (2 - least) / least + _EPS), least)


@lru_cache(maxsize=8)
def _sizes(least: float) -> list[int]:
    """By a text's length: the size of its segments, that of a longer text's at most, so that there are few sizes to look for."""
    out = [n // (_unmatched(n, least) // 2 + 1) if n else 0 for n in range(LONG + 1)]
    for n in range(LONG - 1, 0, -1):
        out[n] = min(out[n], out[n + 1])
    return out


def _starts(n: int, least: float) -> list[int]:
    """Where a text's segments begin: so many that one of them holds one unmatched character of either text at most."""
    q, k = _sizes(least)[n], _unmatched(n, least) // 2 + 1
    return [i * q + (n - k * q) * i // max(1, k - 1) for i in range(k)]


def _tagged(h: np.ndarray, q: int, less: bool) -> np.ndarray:
    """Hashes of segments of size q, whole or with one character less."""
    return h ^ np.uint64((2 * q + less) * _TAG % (1 << 64))


def _without(h: np.ndarray, start: np.ndarray, q: int, p: int) -> np.ndarray:
    """Hashes of the q characters from each start without the p-th."""
    return (h[start + p] - h[start] * _POWERS[p]) * _POWERS[q - 1 - p] + h[start + q] - h[start + p + 1] * _POWERS[q - 1 - p]


def _segments(codes: np.ndarray, h: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, starts, which are new): a text's segments, whole and without one character each; a row for each start."""
    n = len(codes)
    q, start = _sizes(least)[n], np.array(_starts(n, least))
    yield _tagged(h[start + q] - h[start] * _POWERS[q], q, False), start, None
    for p in range(q if _unmatched(n, least) else 0):
        yield _tagged(_without(h, start, q, p), q, True), start, codes[start + p] != codes[start + p - 1] if p else None


def _probes(codes: np.ndarray, h: np.ndarray, least: float, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of what in a text may be a segment of a text of lo to hi characters: whole, one character less, one more."""
    m, k = len(codes), least / (2 - least)
    for q in sorted({_sizes(least)[n] for n in range(max(1, lo, math.ceil(m * k - _EPS)), min(hi, LONG, math.floor(m / k + _EPS)) + 1)}):
        for size in (q, q - 1):
            start = np.arange(max(0, m - size + 1))
            yield _tagged(h[start + size] - h[start] * _POWERS[size], q, size < q), start, None
        start = np.arange(max(0, m - q))
        for p in range(1, q):
            yield _tagged(_without(h, start, q + 1, p), q, False), start, codes[start + p] != codes[start + p - 1]


def _bags(codes: np.ndarray) -> np.ndarray:
    """64 bits of each text, of which one unmatched character changes one at most: characters in 32 classes, counted up to 4 in a ring."""
    kind = codes & 31
    ring = np.array([0, 1, 3, 2], np.uint64)
    return np.bitwise_or.reduce([ring[(kind == c).sum(axis=0) % 4] << np.uint64(2 * c) for c in range(32)])


def _keyed(texts: DataFrame, keys) -> DataFrame:
    """(id, t) -> (key, id, n, at, bag): hashes of parts of each text, and where they begin."""

    def made(ids: list[int], some: list[str]) -> pa.RecordBatch:
        # one text is one column
        codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(len(some), -1).T
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        h = np.zeros((len(codes) + 1, len(some)), np.uint64)
        for i, c in enumerate(mixed):
            h[i + 1] = h[i] * np.uint64(_BASE) + c
        out = []
        for key, start, new in keys(codes, h):
            row, which = np.nonzero(np.ones(key.shape, bool) if new is None else new)
            out.append((key[row, which], which, start[row]))
        key, which, at = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
        columns = key.view(np.int64), np.array(ids)[which], np.full(len(key), len(codes), np.int32), at.astype(np.int32), _bags(codes).view(np.int64)[which]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n", "at", "bag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_length = defaultdict(list)
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
                by_length[len(t)].append((i, t))
            for n, rows in by_length.items():
                step = _CHARS // n
                for at in range(0, len(rows), step):
                    yield made(*map(list, zip(*rows[at : at + step], strict=True)))

    return texts.mapInArrow(run, "key long, id long, n int, at int, bag long")


def _rare_grams(texts: DataFrame, least: float) -> DataFrame:
    """(id, t, s) -> (id, s, n, gram): each text's rarest bigrams, as many as make any partner share one.

    A ratio r of T characters means rT/2 matched ones, in (1 - r) T + 1 blocks at most, and a block of k characters is k - 1
    bigrams of either text: so many are shared, the fewest with the shortest partner. Repeated bigrams are told apart by
    their number, so that the second "an" of a text meets only another's second."""
    n = F.length("t")
    total = n * (1 + least / (2 - least))
    need = F.ceil(total * (least / 2) - total * (1 - least) - 1 - _EPS)
    grams = texts.select("id", "s", n.alias("n"), need.alias("need"), F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("t", i, F.lit(2)))).alias("g"))
    counted = grams.groupBy("id", "s", "n", "need", "g").agg(F.count("*").cast("int").alias("times"))
    told = counted.select("id", "s", "n", "need", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.struct(F.col("g"), k.alias("k")))).alias("gram"))
    ranked = told.hint("merge").join(told.groupBy("gram").agg(F.count("*").alias("df")), "gram").groupBy("id", "s", "n", "need").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("e"))
    return ranked.select("id", "s", "n", F.explode(F.transform(F.slice("e", F.lit(1), (F.size("e") - F.col("need") + 1).cast("int")), lambda x: x["gram"])).alias("gram"))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows that are few bytes but much work, over all tasks."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // _TASK)))


def similar(left: DataFrame, right: DataFrame, least: float = 0.92) -> DataFrame:
    """(text) x (text) -> (left, right, ratio): the distinct pairs of texts whose ``SequenceMatcher`` ratio is ``least`` or more.

    A ratio r of together T characters leaves (1 - r) T of them unmatched at most, so of half as many segments of one text, and one
    more, one is in the other text with one character more or less at most, at a place that is moved by no more than that. Segments
    of the larger side, whole and without a character, are joined by their hashes with all parts of the other side's texts that
    they may be; of what meets, place and counts of characters have to fit. Texts of over ``LONG`` characters meet by their rarest
    bigrams instead. The pairs then pass the bound of characters in any order, and what is left the exact ratio, in Arrow batches.
    Nothing is lost, whatever is frequent; pairs are fewer the larger ``least`` is.

    Equal texts are one row; null and empty texts match nothing. ``least`` is 0.7 at least. No pair: no row.
    """
    if not 0.7 <= least <= 1:
        raise ValueError("least is 0.7 to 1")
    k = least / (2 - least)
    side = lambda rows, s: rows.where("text <> ''").select(F.col("text").alias("t"), F.lit(s).alias("s")).distinct()
    sides = side(left, 1).unionByName(side(right, 2)).groupBy("t").agg(F.bit_or("s").alias("s"))
    texts = cut(sides.withColumn("id", F.monotonically_increasing_id()).withColumn("n", F.length("t")), "texts")  # read for segments, for parts and for pairs
    of = [F.when(F.col("s").bitwiseAND(s) > 0, F.col("n")) for s in (1, 2)]
    lo1, hi1, lo2, hi2 = (x or 0 for x in texts.agg(*(f(c) for c in of for f in (F.min, F.max))).first())
    # of lengths that any of the others could match
    fit = [c.between(lo * k - _EPS, hi / k + _EPS) for c, lo, hi in zip(of, (lo2, lo1), (hi2, hi1), strict=True)]
    short = [texts.where(f).where(F.col("n") <= LONG) for f in fit]
    (n1, lo1, hi1), (n2, lo2, hi2) = (f.agg(F.count("*"), F.coalesce(F.min("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first() for f in short)
    one, two, lo, hi = ("a", "b", lo1, hi1) if n1 >= n2 else ("b", "a", lo2, hi2)  # parts are more than segments
    x = _keyed(_dealt(short[one == "b"].select("id", "t"), max(n1, n2)), lambda codes, h: _segments(codes, h, least))
    y = _keyed(_dealt(short[two == "b"].select("id", "t"), min(n1, n2)), lambda codes, h: _probes(codes, h, least, lo, hi))
    x, y = (z.select("key", F.col("id").alias(c), *(F.col(v).alias(f"{v}{c}") for v in ("n", "at", "bag"))) for z, c in ((x, one), (y, two)))
    apart, more, moved = F.floor((1 - least) * (F.col("na") + F.col("nb")) + _EPS), F.col(f"n{two}") - F.col(f"n{one}"), 2 * (F.col(f"at{two}") - F.col(f"at{one}"))
    fits = (F.abs(more) <= apart) & moved.between(more - apart, more + apart) & (F.bit_count(F.col("baga").bitwiseXOR(F.col("bagb"))) <= apart)
    met = x.hint("merge").join(y, "key").where(fits).select("a", "b").distinct()
    long = texts.where(F.coalesce(fit[0], F.lit(False)) | F.coalesce(fit[1], F.lit(False))).where(F.col("n") >= LONG * k)
    if (long.agg(F.max("n")).first()[0] or 0) > LONG:
        grams = _rare_grams(long, least)
        u, v = (grams.where(F.col("s").bitwiseAND(s) > 0).select("gram", F.col("id").alias(c), F.col("n").alias(f"n{c}")) for c, s in (("a", 1), ("b", 2)))
        fits = (F.greatest("na", "nb") > LONG) & (F.least("na", "nb") >= F.greatest("na", "nb") * k - _EPS)
        met = met.unionByName(u.hint("merge").join(v, "gram").where(fits).select("a", "b").distinct())  # their sizes are no multiple of the texts'
    named = lambda c, name: texts.select(F.col("id").alias(c), F.col("t").alias(name))
    found = _dealt(met.hint("merge").join(named("a", "left"), "a").hint("merge").join(named("b", "right"), "b").select("left", "right"), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            match, last = SequenceMatcher(), None
            for l, r in sorted(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True), key=lambda p: p[1]):
                if r != last:
                    match.set_seq2(r)  # what is costly is kept for the second text
                    last = r
                match.set_seq1(l)
                if match.real_quick_ratio() >= least and match.quick_ratio() >= least and (ratio := match.ratio()) >= least:
                    out.append((l, r, ratio))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["left", "right", "ratio"])

    return found.mapInArrow(run, "left string, right string, ratio double")


def best_matches(titles: DataFrame, among: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, title) x (id, title) -> (id, match, ratio): for each title the most similar of the others, compared as normalised
    titles; ties by the smallest id. Titles without a match of ``least`` aren't returned."""
    from ..functions.text import normalize_title

    # made once, from whatever they come
    t = cut(titles.select("id", normalize_title(F.col("title")).alias("left")), "titles")
    o = cut(among.select(F.col("id").alias("match"), normalize_title(F.col("title")).alias("right")), "among")
    pairs = similar(t.select(F.col("left").alias("text")), o.select(F.col("right").alias("text")), least)
    firsts = o.where("right <> ''").groupBy("right").agg(F.min("match").alias("match"))  # copies of a title are one
    best = pairs.join(firsts, "right").groupBy("left").agg(F.max(F.struct("ratio", (-F.col("match")).alias("m"))).alias("b"))
    return t.join(best, "left").select("id", (-F.col("b.m")).alias("match"), "b.ratio")
