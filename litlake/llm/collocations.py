"""Phrase collocations: stretches of texts whose sketched counts reach the limit, counted by automata over shards of them."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import cut, discard
from ._shared import text_chunks
from ._words import _BASE, _powers, mix

#: Words of a phrase at most, bytes between words, bytes between pieces.
LONGEST, SPACES, BREAKS = 5, b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bits of a block of counters; occurrences for each counter of the sketch (as a power of two), and counters at most: the
#: sketch grows with the corpus up to 256 MB of bits, beyond which it lets more candidates through, but loses none.
BLOCK, LOAD, MOST_BITS = 19, 3, 31
#: Words whose phrases are sorted at once, stretches held at once, and phrases of one automaton: they bound a worker's memory,
#: not what is processed.
FLUSH, HELD, SHARD = 2_000_000, 500_000, 60_000
#: Words of a scan's task at least: each task tells every stretch that it holds, so many small ones would tell them often.
TASK_WORDS = 24_000_000

_CLASS = np.zeros(256, np.int8)
_CLASS[list(SPACES)], _CLASS[list(BREAKS)] = 1, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = bytes(10 if c in BREAKS else 32 if c in SPACES else _LOWER[c] for c in range(256))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Tokens:
    """Words of texts, as bytes: keys of (language, word), where they start and end, their text, and runs of one piece."""

    def __init__(self, texts: Sequence[str | None], langs: Sequence[str]):
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        self.data = b"\n".join([*raw, b""])
        codes = np.frombuffer(self.data, np.uint8)
        n, kind = len(codes), _CLASS[codes]
        edge = np.diff(np.concatenate([[0], kind == 0, [0]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.text = np.searchsorted(ends, self.starts, "right")
        self.keys = mix(hashes + np.array([_seed(x) for x in langs], np.uint64)[self.text]) if len(texts) else hashes
        self.piece = np.cumsum(kind == 2)[self.starts]

    def phrase(self, first: int, words: int) -> str:
        raw = self.data[self.starts[first] : self.ends[first + words - 1]]
        return b" ".join(raw.translate(_PLAIN).split()).decode("utf-8", "surrogatepass")

    def phrases(self, usual: Bits) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, keys, first words) of the phrases of n words of one piece, all of them in ``usual``."""
        known = usual.has(self.keys)
        run = np.cumsum(np.concatenate([[1], np.diff(self.piece)]) + ~known) if len(known) else self.piece
        run, at, key = np.where(known, run, -1 - np.arange(len(run))), np.arange(len(run)), self.keys
        for n in range(2, LONGEST + 1):
            same = run[n - 1 :] == run[: max(0, len(run) - n + 1)]
            at = at[at < len(same)]
            at = at[same[at]]
            key = key * _BASE
            key[at] = mix(key[at] + self.keys[at + n - 1])
            yield n, key[at], at


class Bits:
    """A set of 64-bit keys by their upper bits; it may hold more keys than were put in, but never fewer."""

    def __init__(self, bits: int, blocks: dict[int, bytes], size: int = BLOCK):
        self.bits = bits
        self.array = np.zeros(max(1, 1 << bits >> 3), np.uint8)
        for i, b in blocks.items():
            self.array[i << size >> 3 : (i << size >> 3) + len(b)] = np.frombuffer(b, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.array[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _bits_for(n: int, load: int) -> int:
    return min(MOST_BITS, max(BLOCK, int(n).bit_length() - load))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str | None], list[str]]]:
    for b in batches:
        langs = b.column("lang").to_pylist()
        for begin, end, texts in text_chunks(b.column("text")):
            yield texts, langs[begin:end]


def _entries(keys: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(block, counters): each counter as its place in the block and up to 4,095 occurrences, in 32 bits."""
    at, n = np.unique((keys >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
    while len(at):
        cells = (at & np.uint32((1 << BLOCK) - 1)) << np.uint32(12) | np.minimum(n, 4095).astype(np.uint32)
        blocks = at >> np.uint32(BLOCK)
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for first, part in zip([0, *edges], np.split(cells, edges), strict=True):
            yield int(blocks[first]), part.tobytes()
        left = n > 4095
        at, n = at[left], n[left] - 4095


def _heavy(entries: DataFrame, bits: int, least: int) -> Bits:
    """The keys whose counters, summed by block, reach ``least``."""

    def total(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << BLOCK, np.int64)
        for cells in table["cells"]:
            x = np.frombuffer(cells.as_buffer(), np.uint32)
            np.add.at(sums, x >> np.uint32(12), (x & np.uint32(4095)).astype(np.int64))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(sums >= least).tobytes()], pa.binary())})

    rows = entries.groupBy("block").applyInArrow(total, "block int, bits binary").collect()  # 1/8 of a byte a counter
    return Bits(bits, {r["block"]: r["bits"] for r in rows})


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): every word's occurrences in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for (lang, w), n in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "phrase", "f"])

        for texts, langs in _chunks(batches):
            t = Tokens(texts, langs)
            _, at, n = np.unique(t.keys, return_index=True, return_counts=True)
            for i, text, k in zip(at.tolist(), t.text[at].tolist(), n.tolist(), strict=True):
                found[langs[text], t.phrase(i, 1)] += k
            if len(found) > 200_000:
                yield out()
        if found:
            yield out()

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _usual_words(words: DataFrame, least: int) -> Bits:
    usual = words.where(F.col("f") >= least).select("lang", "phrase")
    bits = _bits_for(usual.count(), -6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Tokens(b.column("phrase").to_pylist(), b.column("lang").to_pylist())
            out = list(_entries(t.keys, bits))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary()), strict=True)] if out else [pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "cells"])

    return _heavy(usual.mapInArrow(run, "block int, cells binary"), bits, 1)


def stretches(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): at every word the longest phrase that may occur ``least`` times, and how often it is the longest there.

    A phrase of 2 to 5 words may if its counter in the sketch is as large, as are its parts', and it holds no rarer word. So a
    phrase that does occur ``least`` times begins a stretch wherever it stands, and there are no more stretches than such
    phrases, however long the texts are."""
    spark = docs.sparkSession
    usual = spark.sparkContext.broadcast(_usual_words(words, least))
    bits = _bits_for((LONGEST - 1) * (words.agg(F.sum("f")).first()[0] or 0), LOAD)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = list(_entries(np.concatenate(held), bits))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "cells"])

        for texts, langs in _chunks(batches):
            held += [keys for _, keys, _ in Tokens(texts, langs).phrases(usual.value)]
            if sum(map(len, held)) > FLUSH:
                yield out()
        if held:
            yield out()

    heavy = spark.sparkContext.broadcast(_heavy(docs.mapInArrow(counted, "block int, cells binary"), bits, least))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "phrase", "n"])

        for texts, langs in _chunks(batches):
            t = Tokens(texts, langs)
            ok, size, whole = np.ones(len(t.keys) + 1, bool), np.zeros(len(t.keys), np.int8), np.zeros(len(t.keys), np.uint64)
            for n, keys, at in t.phrases(usual.value):
                good = heavy.value.has(keys) & ok[at] & ok[at + 1]
                ok = np.zeros(len(ok), bool)
                ok[at[good]] = True
                size[at[good]], whole[at[good]] = n, keys[good]
            at = np.flatnonzero(size)
            new, first, times = np.unique(whole[at], return_index=True, return_counts=True)
            for key, i, k in zip(new.tolist(), at[first].tolist(), times.tolist(), strict=True):
                if key in held:
                    held[key][2] += k
                else:
                    held[key] = [langs[t.text[i]], t.phrase(i, int(size[i])), k]
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    return docs.mapInArrow(found, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _automaton(phrases: Iterable[str]) -> object:
    """Every phrase between two spaces, which neighbours share, with its number and its length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, text in enumerate(phrases):
        a.add_word(f" {text} ", (i, len(text) + 2))
    a.make_automaton()
    return a


def begun(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """``stretches`` -> (lang, phrase, f): the occurrences of all phrases of two words or more that begin a stretch. Stretches are
    dealt by their first two words, so that an automaton of about ``shard`` of them meets each of its phrases' stretches and no
    stretch is read twice: neither automata nor scans grow with the corpus."""
    found = cut(found, "stretches")
    shards = max(1, -(-found.count() // shard))

    def scan(table: pa.Table) -> pa.Table:
        by: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for lang, text, n in zip(*(table[c].to_pylist() for c in ("lang", "phrase", "n")), strict=True):
            by[lang].append((text, n))
        rows = []
        for lang, group in by.items():
            phrases = sorted({text[:end] for text, _ in group for end in [*[m.start() for m in re.finditer(" ", text)][1:], len(text)]})
            a, total = _automaton(phrases), [0] * len(phrases)
            for text, n in group:
                for end, (i, size) in a.iter(f" {text} "):
                    if end + 1 == size:  # others begin stretches of their own
                        total[i] += n
            rows += [(lang, p, f) for p, f in zip(phrases, total, strict=True)]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "f"])

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(scan, "lang string, phrase string, f long")


_BUILT: dict[str, object] = {}


def _automata(name: str, phrases: dict[str, tuple[list[str], list[int]]]) -> dict[str, object]:
    """An automaton for each language, built once a worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = {lang: (_automaton(texts), np.array(ids)) for lang, (texts, ids) in phrases.items()}
    return _BUILT[name]


def guarded(text: str) -> str:
    """A text as automata read it: A-Z lower-cased, words between single spaces, pieces between line feeds."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b"\n", b" \n ")
    return re.sub(rb"  +", b" ", b" " + data + b" ").decode("utf-8", "surrogatepass")


def exact_counts(docs: DataFrame, phrases: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, f): any given phrases' occurrences in their language, overlapping ones included. Each shard of the phrases
    is one scan of the texts, so this is for phrases that don't grow with these; those of a shard are all that the driver ever
    holds."""
    spark = docs.sparkSession
    phrases = cut(phrases, "phrases")
    shards = max(1, -(-phrases.count() // shard))
    numbered = phrases.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).cast("int"))
    done = []
    for s in range(shards):
        rows = sorted(map(tuple, numbered.where(F.col("shard") == s).select("lang", "phrase").collect()))
        by: dict[str, tuple[list[str], list[int]]] = {}
        for i, (lang, phrase) in enumerate(rows):
            texts, ids = by.setdefault(lang, ([], []))
            texts.append(phrase)
            ids.append(i)
        sent, name, size = spark.sparkContext.broadcast(by), f"{phrases.cut_path}/{s}", len(rows)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, name=name, size=size) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for texts, langs in _chunks(batches):
                joined: dict[str, list[str]] = defaultdict(list)
                for text, lang in zip(texts, langs, strict=True):
                    if text and lang in sent.value:
                        joined[lang].append(text)
                for lang, group in joined.items():
                    a, ids = _automata(name, sent.value)[lang]
                    hits = (i for _, (i, _) in a.iter(guarded("\n".join(group))))
                    total += np.bincount(ids[np.fromiter(hits, np.int64)], minlength=size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "f"])

        counts = docs.mapInArrow(scan, "id long, f long").groupBy("id").agg(F.sum("f").alias("f"))

        def named(batches: Iterator[pa.RecordBatch], sent=sent, size=size) -> Iterator[pa.RecordBatch]:
            names: list = [None] * size
            for lang, (texts, ids) in sent.value.items():
                for text, i in zip(texts, ids, strict=True):
                    names[i] = (lang, text)
            for b in batches:
                ids = b.column("id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([names[i][0] for i in ids], pa.string()), pa.array([names[i][1] for i in ids], pa.string()), b.column("f")], ["lang", "phrase", "f"])

        done.append(cut(counts.mapInArrow(named, "lang string, phrase string, f long"), "counted"))
        sent.unpersist()
    discard(spark, phrases)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, share: int = 100, shard: int = SHARD) -> DataFrame:
    """Each language's ``most`` best phrases of 2 to 5 words that occur ``least`` times: lang, rank, phrase, a, l, r, n, score.

    Words are runs without spaces, tabs and ``.,;:!?`` or line ends; the latter also end pieces, which no phrase crosses. A-Z
    are lower-cased. a, l, r are the occurrences of a phrase and of the two parts whose cut scores least, n those of all words,
    score = floor(1000 a n / (l r)), exact. A phrase inside a longer one goes if 100 times the longer one's occurrences are
    ``share`` times its own at least.

    Words are counted first, then a sketch of hashed phrases bounds all counts from above (its counters are summed by Spark
    in blocks and come to the driver as one bit each). The texts are then cut into the longest phrases that may reach ``least``,
    and automata count all phrases in these. The texts are read three times, however many phrases there are; the sketch and the
    phrases grow with the corpus where ``least`` doesn't.

    A null lang is ``und``, null texts have no word. Repeated rows count each; other columns are ignored; no word: no row.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = cut(word_counts(docs), "words")
    docs = docs.coalesce(max(1, -(-(words.agg(F.sum("f")).first()[0] or 0) // TASK_WORDS)))
    counts = begun(stretches(docs, words, least), shard)
    counts = cut(counts.where(F.col("f") >= least).withColumn("w", F.split("phrase", " ")), "counts")
    n = F.size("w")

    parts = words.where(F.col("f") >= least).unionByName(counts.select("lang", "phrase", "f"))
    side = lambda name: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    cuts = counts.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, n - F.col("k")).alias("rest"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    cuts = cuts.join(side("left"), ["lang", "left"]).join(side("rest"), ["lang", "rest"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"x": F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), "y": big("l") * big("r")}).withColumn("score", F.expr("x div y"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _part(F.col("w"), i, m))))
    longer = counts.where(n > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    best = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def duckdb_sql(least: int = 100, most: int = 2000, share: int = 100) -> str:
    """The same in DuckDB, with all phrases counted."""
    return f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
runs AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
grams AS (SELECT lang, w[i:i + m - 1] AS g FROM spots, range(1, 6) t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1 AND f >= {least}),
halves AS (SELECT lang, g, f AS a, k, array_to_string(g[1:k], ' ') AS x, array_to_string(g[k + 1:], ' ') AS y FROM c, range(1, 5) t(k) WHERE k < len(g)),
named AS (SELECT lang, array_to_string(g, ' ') AS p, f FROM f WHERE f >= {least}),
cuts AS (SELECT h.lang, g, a, k, u.f AS l, v.f AS r, n, ((1000::hugeint * a * n) // (u.f::hugeint * v.f))::bigint AS score
  FROM halves h JOIN named u ON u.lang = h.lang AND u.p = h.x JOIN named v ON v.lang = h.lang AND v.p = h.y JOIN n ON n.lang = h.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(f) AS longest FROM c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < len(g) AND i + m - 1 <= len(g) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, g) WHERE longest IS NULL OR 100 * longest < {share} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {most}"""
