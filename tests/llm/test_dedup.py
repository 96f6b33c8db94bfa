"""Passages, near copies and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litlake.llm import embedding_dedup, near_dedup, substring_dedup as sub
from litlake.llm._shared import components
from litlake.llm._words import shingles_of, words
from litlake.llm.embedding_dedup import near_vectors
from litlake.llm.neighbours import nearest

R = random.Random(3)
VOCABULARY = ["".join(R.choices("abcdefghij", k=R.randint(2, 7))) for _ in range(3000)]


def prose(n):
    return R.choices(VOCABULARY, k=n)


def edited(ws, share):
    return [R.choice(VOCABULARY) if R.random() < share else w for w in ws]


def docs(spark, texts, extra=True):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, sh string, row int")


def sh(text):
    return shingles_of(words([text]).hashes)


def test_compact_windows_are_the_cartesian_trees_wide_nodes():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a[150:] = rng.permutation(a[:150])  # repeats
    fences = np.zeros(300, bool)
    fences[[90, 200]] = True
    left, centre, right, h = sub.compact_windows(a, fences, sub._SEEDS[0])
    v = sub.mix(a ^ sub._SEEDS[0])
    got = set(zip(left.tolist(), centre.tolist(), right.tolist()))
    want = set()
    for i in range(300 - sub.WINDOW + 1):
        if fences[i : i + sub.WINDOW].any():
            continue
        c = i + int(v[i : i + sub.WINDOW].argmin())
        p, q = c, c
        while p and not fences[p - 1] and v[p - 1] >= v[c]:
            p -= 1
        while q < 299 and not fences[q + 1] and v[q + 1] >= v[c]:
            q += 1
        want.add((p, q))
    assert {(p, q) for p, _, q in got} == want and (h == v[centre]).all()


def test_passages_of_fifty_words_are_found_wherever_they_repeat(spark):
    shared, other = prose(60), prose(80)
    texts = [(i, " ".join(prose(200))) for i in range(40)]
    texts[3] = (3, " ".join(prose(30) + shared + prose(20)))
    texts[9] = (9, " ".join(prose(120) + shared + other))
    texts[20] = (20, " ".join(shared + prose(5)))
    texts[21] = (21, " ".join(prose(7) + other + prose(90)))
    texts[30] = (30, " ".join(prose(50) + shared[:40] + prose(50)))  # too short
    texts += [(40, None), (41, ""), (42, "short"), (None, " ".join(shared)), (43, " ".join(["same"] * 400))]
    df = docs(spark, texts)
    found = sub.merged(sub.repeated_passages(df)).collect()
    assert {r["doc_id"] for r in found} == {9, 20, 21}
    by = dict(texts)
    cut = {r["doc_id"]: " ".join(by[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]) for r in found}
    assert cut == {9: " ".join(shared), 20: " ".join(shared), 21: " ".join(other)}
    out = {r["doc_id"]: r for r in sub.remove_passages(df).collect()}
    assert len(out) == len(texts) and out[3]["text"] == by[3] and " ".join(shared) not in out[9]["text"] and out[40]["text"] is None
    assert sub.remove_passages(df).columns == df.columns
    assert sub.repeated_passages(df.limit(0)).count() == 0


def test_passages_with_a_changed_word_are_found(spark):
    base = prose(150)
    texts = [(1, " ".join(prose(40) + base))] + [(i, " ".join(edited(base, 0.015) + prose(40))) for i in range(2, 14)]
    found = {r["doc_id"] for r in sub.repeated_passages(docs(spark, texts)).collect()}
    assert found == set(range(2, 14))


def test_passages_of_rows_that_share_a_doc_id(spark):
    shared = " ".join(prose(70))
    odd = " ".join(prose(90))
    rows = [(1, " ".join(prose(40)) + " " + shared, "a", "b"), (7, odd, "c", "d"), (7, shared + " " + " ".join(prose(50)), "e", "f"), (7, None, "g", "h"), (None, shared, "i", "j")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, spans string, mark string")
        out = sub.remove_passages(df)
        assert out.columns == df.columns
        got = {r["spans"]: r["text"] for r in out.collect()}
        assert got == {r[2]: r[1] for r in rows} | {"e": rows[2][1].replace(shared, "")}


def test_a_passage_twice_in_a_later_document_is_found_twice(spark):
    passage = prose(60)
    texts = [(i, " ".join(prose(120))) for i in range(2, 30)]
    texts[3] = (5, " ".join(prose(20) + passage + prose(50) + passage + prose(20)))
    texts[5] = (7, " ".join(passage + prose(20)))
    df = docs(spark, [(1, " ".join(prose(30) + passage + prose(30))), *texts])
    for parts in (1, 8):
        found = {r["doc_id"]: r["spans"] for r in sub.merged(sub.repeated_passages(df.repartition(parts))).collect()}
        assert set(found) == {5, 7} and len(found[5]) == 2
        assert all(dict(texts)[5][s["start"] : s["end"]] == " ".join(passage) for s in found[5])


def test_edited_passages_of_fifty_words_are_found(spark):
    # the hardest case: fifty words with one changed in the middle have 41 of 51 shingles in common
    r = random.Random(21)
    texts = []
    for i in range(300):
        p = r.choices(VOCABULARY, k=50)
        q = [*p[:25], "changed", *p[26:]]
        texts += [(i, " ".join(r.choices(VOCABULARY, k=30) + p)), (1000 + i, " ".join(q + r.choices(VOCABULARY, k=30)))]
    found = {x["doc_id"] for x in sub.repeated_passages(docs(spark, texts)).collect()}
    assert len(found & set(range(1000, 1300))) >= 297


def aligned_share(a, b):
    """Longest common subsequence of shingles over the union, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def test_alignment_is_the_longest_common_subsequence():
    for _ in range(120):
        ws = prose(R.randint(3, 60))
        other = edited(ws, R.choice([0, 0.02, 0.1]))
        if R.random() < 0.3:
            k = R.randrange(len(other))
            other = other[k:] + other[:k]
        if R.random() < 0.3:
            ws, other = ws + ws, other + ws
        a, b = sh(" ".join(ws)), sh(" ".join(other))
        assert near_dedup.aligned(a, b) == (aligned_share(a.tolist(), b.tolist()) >= 0.8 - 1e-9)


def brute_classes(texts):
    s = {i: sh(t).tolist() for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in texts]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if s[i] and s[j] and aligned_share(s[i], s[j]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_copies_form_the_classes_of_brute_force(spark):
    texts, i = [], 0
    for _ in range(14):
        base = prose(R.randint(5, 90))
        for _ in range(R.randint(1, 5)):
            texts.append((i, " ".join(edited(base, R.choice([0, 0.01, 0.03])))))
            i += 1
    for t in ("", "?!", "one", "one", "ONE!", "two words"):
        texts.append((i, t))
        i += 1
    df = docs(spark, texts)
    got = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_copies_edge_cases(spark):
    t = " ".join(prose(50))
    df = docs(spark, [(5, t), (5, t), (2, t), (None, t), (7, None), (8, "")])
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 4
    kept = near_dedup.keep_one(df)
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(2,), (None,), (7,), (8,)], key=str) and kept.columns == df.columns
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_told_apart_by_their_texts(spark):
    x, y, z = (" ".join(prose(60)) for _ in range(3))
    near = x.rsplit(" ", 1)[0] + " other"
    rows = [(1, x, "a", 1), (1, y, "b", 2), (1, y, "b", 3), (3, near, "c", 4), (3, z, "d", 5), (4, z, "e", 6), (4, "", "f", 7), (4, "", "f", 8), (None, x, "g", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole string, t int").repartition(3)
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, False), (1, 1, True), (1, 1, True), (3, 1, False), (3, 3, True), (4, 3, False), (4, 4, True), (4, 4, True)]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, x), (1, x), (1, y), (3, z), (4, ""), (4, "")])
    assert near_dedup.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("share, hot", [(0.008, 20_000), (0.011, 20), (0.014, 20_000), (0.018, 20)])
def test_a_large_group_of_near_copies_is_one_class(spark, monkeypatch, share, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    base = prose(100)
    texts = [(i, " ".join(edited(base, share))) for i in range(120)]
    want = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == want


def test_near_copies_that_share_only_large_buckets_are_found(spark):
    # drifting edits of a few templates: each bucket holds far more texts than the leaders reach, and few of them are alike
    r = random.Random(11)
    texts = []
    for share in (0.01, 0.016, 0.022):
        base = r.choices(VOCABULARY, k=120)
        for _ in range(120):
            texts.append((len(texts), " ".join(w if r.random() > share else r.choice(VOCABULARY) for w in base)))
    s = [sh(t) for _, t in texts]
    edges = [(i, j) for j in range(len(s)) for i in range(j // 120 * 120, j) if near_dedup.aligned(s[i], s[j])]
    want, before = list(range(len(s))), None
    while want != before:
        before = list(want)
        for i, j in edges:
            want[i] = want[j] = min(want[i], want[j])
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_pairs_left_out_of_a_bucket_are_not_alike():
    r = random.Random(12)
    base = r.choices(VOCABULARY, k=330)
    texts = [" ".join(w if r.random() > p else r.choice(VOCABULARY) for w in base[: r.randint(200, 330)]) for p in [0.002, 0.01, 0.02, 0.04] * 15]
    s = [sh(t) for t in texts]
    doc, n = np.arange(len(s)), np.array([len(x) for x in s])
    maps = [near_dedup.parity_map(x).tobytes() for x in s]
    assert len({len(m) for m in maps}) > 1
    want = {(i, j) for j in doc for i in range(j) if near_dedup.aligned(s[i], s[j])}
    sketch = np.zeros((len(s), near_dedup.SKETCHES), np.int64)
    got = set(zip(*(x.tolist() for x in near_dedup.open_pairs(doc, n, doc, maps, doc * 0, False, sketch, 0))))
    assert want and want <= got
    side = doc % 2
    across = set(zip(*(x.tolist() for x in near_dedup.open_pairs(doc, n, doc, maps, side, True, sketch, 0))))
    assert across == {(i, j) for i, j in got if side[i] != side[j]}


def test_blocks_of_a_bucket_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r = random.Random(13)
    base = r.choices(VOCABULARY, k=100)
    texts = [(i, " ".join(w if r.random() > 0.004 else r.choice(VOCABULARY) for w in base)) for i in range(50)]
    df = docs(spark, texts)
    rows = spark.createDataFrame([(1, 0, i, len(sh(t)), 0 if i < 25 else i) for i, t in texts], "key long, place int, doc long, n int, root long")
    nodes = spark.createDataFrame([(i, [1] * near_dedup.SKETCHES) for i, _ in texts], "node long, sketch array<long>")
    shingles = near_dedup.shingle_rows(df, df.select(*near_dedup.text_key(), F.col("doc_id").alias("node")))
    found = {tuple(x) for x in near_dedup.verified(near_dedup.all_pairs(rows, shingles, nodes), shingles).collect()}
    s = dict((i, sh(t)) for i, t in texts)
    assert found == {(i, j) for j in range(25, 50) for i in range(j) if near_dedup.aligned(s[i], s[j])}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")


@pytest.mark.parametrize("block", [2048, 16])
def test_linked_vectors_and_neighbours_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "NODE", 2 * block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[100:200] = x[:100] + rng.normal(size=(100, 12)) * rng.choice([0.0, 0.15, 0.3, 0.5], size=(100, 1))
    x *= rng.uniform(0.5, 2, size=(300, 1))
    x = x.astype(np.float32)
    label = rng.integers(0, 3, 300)
    rows = [(i, v.tolist(), int(c), "clash") for i, (v, c) in enumerate(zip(x, label))]
    odd = [(300, None, 1, ""), (301, [0.0] * 12, 1, ""), (302, [float("nan")] * 12, 1, ""), (303, [], 1, ""), (304, x[0].tolist(), None, ""), (305, [1.0, None] + [0.0] * 10, 1, ""), (306, [1.0, 2.0], 1, "")]
    df = vectors(spark, rows + odd)
    d = x.astype(float)
    u = d / np.sqrt((d**2).sum(axis=1))[:, None]
    hit = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    root = np.arange(300)
    while (new := np.minimum(root, np.where(hit, root[None], 1000).min(axis=1))).tolist() != root.tolist():
        root = new
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == 307
    assert [got[i]["n_links"] for i in range(300)] == hit.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(300)] == root.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(300, 307))
    assert near_vectors(df.limit(0)).count() == 0

    if block < 2048:
        return
    found: dict[int, list] = {}
    for r in nearest(df, every=20, k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    base = np.concatenate([d, d[:1]])  # 304 has a vector
    ids = np.array([*range(300), 304])
    hits = 0
    assert sorted(found) == list(range(0, 300, 20))
    for q, got_q in found.items():
        score = (base * d[q]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        hits += len({int(ids[k]) for k in order} & {v for v, _ in got_q})
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in got_q)
    assert hits >= 0.9 * 5 * len(found)
    assert nearest(df.limit(0)).count() == 0


def test_upper_levels_leave_out_far_nodes_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "NODE", 20)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(12, 8)), 40, axis=0) + rng.normal(size=(480, 8)) * 0.25
    x[100:130] = x[100]  # copies
    x = x.astype(np.float32).astype(float)
    u = x / np.sqrt((x**2).sum(axis=1))[:, None]
    hit = u @ u.T >= 0.93
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, path string")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df).collect()}
    assert [got[i] for i in range(480)] == hit.sum(axis=1).tolist()
    same = df.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("times"), "label", F.lit(8).alias("dim"), F.col("embedding").alias("v"))
    paths = embedding_dedup.divided(same).select("rep", "path").collect()
    assert len(paths) == 480 and max(len(r["path"]) for r in paths) >= 2
    ball = spark.createDataFrame([(i, [0, i // 2], [float(i // 2 * 10), 0.0], 0.1) for i in range(1, 9)], "part long, path array<long>, mid array<double>, radius double")
    assert {tuple(r) for r in embedding_dedup.near_parts(ball, 1.0).collect()} == {(i, j) for i in range(1, 9) for j in range(i, 9) if i // 2 == j // 2}
