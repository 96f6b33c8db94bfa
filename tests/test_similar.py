"""Title joins and exact linkage against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from litlake.functions import text
from litlake.operators import linkage, similar


def titles(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ge", "ne", "ti", "ca", "lo") for b in ("no", "ra", "li") for c in ("me", "tion", "ct", "s")]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(t) // 8))):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab", " "])
            t = "".join(t)
        else:
            t = " ".join(rng.choices(words, k=rng.randint(1, 9)))[: rng.randint(1, 70)]
        out.append(t or "a")
    return out


@pytest.mark.parametrize("least", [0.7, 0.85, 0.92, 1.0])
def test_no_pair_is_lost(spark, least):
    a, b = titles(350, 1), titles(350, 1)[::-1][:200] + titles(150, 2)
    long = [" ".join(titles(12, s))[:n] for s, n in ((7, 250), (8, 262), (9, 400))]
    a, b = a + long, b + [x[: len(x) // 2] + y + x[len(x) // 2 + k :] for x in long for y, k in (("", 3), ("abc d", 0), ("zz" * 9, 20))]
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, ""]], "text string")
    want = {(x, y): r for x in set(a) for y in set(b) if (r := SequenceMatcher(None, x, y).ratio()) >= least}
    got = {(r["left"], r["right"]): r["ratio"] for r in similar.similar(frame(a), frame(b), least).collect()}
    assert got == want and len(want) > 100


def test_best_matches(spark):
    a = spark.createDataFrame([(1, "The Cell Cycle of Yeast"), (2, "Nothing alike"), (3, None), (4, "the cell-cycle of yeast!")], "id long, title string")
    b = spark.createDataFrame([(9, "The cell cycles of yeast"), (7, "the cell cycle of yeast"), (8, "The Cell Cycle of Yeast"), (5, "")], "id long, title string")
    assert {tuple(r) for r in similar.best_matches(a, b).collect()} == {(1, 7, 1.0), (4, 7, 1.0)}
    with pytest.raises(ValueError):
        similar.similar(a, b, 0.69)


def joined(df):
    """Rows that the joins of an executed query let through."""

    def below(p):
        if "AdaptiveSparkPlan" in p.nodeName():
            p = p.executedPlan()
        while "QueryStage" in p.getClass().getSimpleName():
            p = p.plan()
        mine = p.metrics().apply("numOutputRows").value() if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") else 0
        return mine + sum(below(p.children().apply(i)) for i in range(p.children().size()))

    return below(df._jdf.queryExecution().executedPlan())


def test_unlike_titles_of_the_same_words_do_not_meet(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "and", "ere", "ion", "of") for b in ("", "re", "in", "tion", "sh", "ly")]
    a, b = ([" ".join(rng.choices(words, k=20))[: rng.randint(54, 60)] for _ in range(300)] for _ in "ab")
    b += [x[:20] + "q" + x[22:] for x in a[:40]]
    df = similar.similar(*(spark.createDataFrame([(x,) for x in xs], "text string") for xs in (a, b)))
    got = {(r["left"], r["right"]) for r in df.collect()}
    assert got == {(x, y) for x in set(a) for y in set(b) if SequenceMatcher(None, x, y).ratio() >= 0.92} and len(got) >= 40
    assert 0 < joined(df) <= len(a) * len(b) // 20


def test_titles_are_made_once(spark, tmp_path):
    def made(x):
        with open(tmp_path / "made", "a") as f:
            f.write(f"{x}\n")
        return x

    a, b = ([f"{w} cell cycle of yeast number {i}" for i in range(n)] for w, n in (("The", 20), ("the", 30)))
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "id long, title string").select("id", F.udf(made)("title").alias("title"))
    assert similar.best_matches(frame(a), frame(b)).count() == 20
    assert (tmp_path / "made").read_text().count("\n") == 50


def test_first_sentence(spark):
    rows = ["One. Two.", " \n One?!\tTwo", ". Two", " . ", "", " \t\n", None, "No end", "a.b. \x0b c", "x \u2028", "!\u00a0y. z", "e.g.\r\nnext", "1. \n\n 2. 3"]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(F.get(text.sentences(F.col("x")), F.lit(0)).alias("want"), text.first_sentence(F.col("x")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def one_by_one(x, k):
    """Average linkage with all distances written out: the closest pair first, ties by first members."""
    u = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)
    total, size, label = 1 - u @ u.T, np.ones(len(x)), np.arange(len(x))
    alive = list(range(len(x)))
    while len(alive) > k:
        a = np.array(alive)
        mean = np.round(total[np.ix_(a, a)] / np.outer(size[a], size[a]), linkage.DECIMALS)
        mean[np.tril_indices(len(a))] = np.inf
        i, j = (int(a[t]) for t in np.unravel_index(int(mean.argmin()), mean.shape))
        total[i] += total[j]
        total[:, i] += total[:, j]
        size[i] += size[j]
        label[label == j] = i
        alive.remove(j)
    names = {v: n for n, v in enumerate(sorted(set(label.tolist())))}
    return [names[v] for v in label.tolist()]


def groups(rng):
    yield rng.normal(size=(90, 5))
    yield np.repeat(rng.normal(size=(12, 4)), 5, axis=0)  # ties
    yield np.concatenate([rng.normal(size=(60, 3)), np.zeros((3, 3))])
    yield rng.integers(-1, 2, size=(70, 3)).astype(float)
    yield rng.normal(size=(1, 3))
    yield rng.normal(size=(2, 3))
    yield rng.normal(size=(5, 3))


def test_linkage_of_one_task():
    for x in groups(np.random.default_rng(3)):
        ids, k = np.arange(len(x)) * 3, linkage.cluster_count(len(x))
        u = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)
        assert linkage.labels_of(ids, linkage.merged_in_order(ids, u, np.ones(len(x))), k).tolist() == one_by_one(x, k)


@pytest.mark.parametrize("alone, block", [(2048, 1024), (9, 16)])
def test_linkage_of_any_size_is_the_same(spark, alone, block):
    rng, rows, want = np.random.default_rng(7), [], {}
    for g, x in enumerate([rng.normal(size=(80, 6)), rng.normal(size=(40, 6)) + 1, rng.normal(size=(3, 6)), np.concatenate([rng.normal(size=(30, 6)), np.zeros((2, 6))])]):
        ids = [1000 * g + i for i in range(len(x))]
        rows += [(g, i, v.tolist()) for i, v in zip(ids, x, strict=True)]
        want |= dict(zip(ids, one_by_one(x, linkage.cluster_count(len(x))), strict=True))
    df = spark.createDataFrame([*rows, (0, None, [1.0] * 6), (0, 99_999, None)], "g int, id long, v array<double>").repartition(3)
    out = linkage.clusters(df, "g", alone, block).collect()
    assert {r["id"]: r["cluster"] for r in out} == want and len(out) == len(want)
    assert linkage.clusters(df.limit(0), "g", alone).count() == 0


def test_few_rounds_of_linkage(spark, monkeypatch):
    """A cluster that takes in one after the other, and one vector many times over, are no round for each."""
    rng, rounds, nearest = np.random.default_rng(5), [], linkage._nearest
    monkeypatch.setattr(linkage, "_nearest", lambda *a: rounds.append(1) or nearest(*a))
    # ever farther from the first
    angles = np.cumsum(np.linspace(0.001, 0.02, 90))
    chain = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    x = {0: chain, 1: np.concatenate([np.repeat(rng.normal(size=(1, 2)), 60, axis=0), rng.normal(size=(30, 2))])}
    rows = [(g, 1000 * g + i, v.tolist()) for g, of in x.items() for i, v in enumerate(of)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in linkage.clusters(df, "g", 30, 40).collect()}
    assert got == {1000 * g + i: c for g, of in x.items() for i, c in enumerate(one_by_one(of, 8))}
    assert len(rounds) <= 20


@pytest.mark.parametrize("most", [1, 2, 7])
def test_linkage_from_short_lists(spark, most):
    rng, rows, want = np.random.default_rng(11), [], {}
    for g, x in enumerate([*groups(rng), rng.normal(size=(150, 3)), np.concatenate([rng.normal(size=(40, 8)), np.zeros((6, 8))])]):
        rows += [(g, 1000 * g + i, v.tolist()) for i, v in enumerate(x)]
        want |= {1000 * g + i: c for i, c in enumerate(one_by_one(x, linkage.cluster_count(len(x))))}
    df = spark.createDataFrame(rows, "g int, id long, v array<double>").repartition(3)
    assert {r["id"]: r["cluster"] for r in linkage.clusters(df, "g", 9, 16, most).collect()} == want
