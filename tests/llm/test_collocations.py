"""Collocations against plain counting, and their SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from litlake.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, f long"


def plain(rows, least, most, share=100):
    f, out = Counter(), []
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, 6):
                f.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    total = Counter()
    for (lang, w), n in f.items():
        total[lang] += n if len(w) == 1 else 0
    good = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    for lang in total:
        kept = []
        for (at, w), a in good.items():
            if at != lang or any(x == lang and len(v) > len(w) and share * a <= 100 * m and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), m in good.items()):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def made(seed=4):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "ÉTÉ", "été", "the", "of", "aa", "aa", "state-of", "x y", "zz"]
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t ", "  ", ". ", ",", "\n", "\r", "\x0b"]) for w in words))
    texts += ["in the heart of the city"] * 25 + ["aa aa aa aa aa aa"] * 12 + [None, "", " \t", ".,;", "w" * 300_000, "one  two\tthree " * 40]
    return [(i, t, rng.choice(["en", "en", "de", None, "und"]), "clash", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most, shard", [(2000, 60_000), (4, 7)])
def test_equals_plain_counting(spark, most, shard):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, co.collocations(docs, 12, most, shard=shard).collect()))
    assert got == plain(rows, 12, most) and len(got) > 10


def test_sql_says_the_same(spark, tmp_path):
    rows = made(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(co.duckdb_sql(12)).fetchall()) == plain(rows, 12, 2000)


def test_no_word(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, "", 0), (2, " .", "en", "", 0)], SCHEMA)).count() == 0


def test_a_sketch_never_loses_a_key():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    many = np.concatenate([keys, np.repeat(keys[:7], 9000)])
    sums = Counter()
    for block, cells in co._entries(many, 24):
        for c in np.frombuffer(cells, np.uint32).tolist():
            sums[block << co.BLOCK | c >> 12] += c & 4095
    assert sum(sums.values()) == len(many)
    for k, n in Counter(many.tolist()).items():
        assert sums[k >> 40] >= n


def test_phrases_overlap_and_never_cross_pieces(spark):
    docs = spark.createDataFrame([(1, "a b a b a. b a\tb", "en", "", 0)], SCHEMA)
    phrases = spark.createDataFrame([("en", "a b"), ("en", "b a"), ("en", "a b a"), ("en", "a b a b a"), ("de", "a b")], "lang string, phrase string")
    assert {tuple(r) for r in co.exact_counts(docs.select("lang", "text"), phrases).collect()} == {("en", "a b", 3), ("en", "b a", 3), ("en", "a b a", 2), ("en", "a b a b a", 1)}


def test_texts_are_read_as_often_however_many_phrases_there_are(spark):
    rows, read = made(6), spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, SCHEMA).mapInArrow(counting, SCHEMA)
    assert sorted(map(tuple, co.collocations(docs, 12, 2000, shard=5).collect())) == plain(rows, 12, 2000)
    assert read.value == 3 * len(rows)
