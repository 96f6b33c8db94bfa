"""Average linkage of groups of any size: clusters as sums of unit vectors, reciprocal nearest neighbours merged in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import cut, discard
from .graph import components

#: Clusters of a group that one task can merge to the end, clusters of a block, nearest ones that are listed of each. The result doesn't
#: depend on them.
ALONE, BLOCK, LISTED = 2048, 8192, 32
#: Distances are compared to so many decimals, then by their clusters' first members.
DECIMALS = 9


def cluster_count(n: int, smallest: int = 2) -> int:
    return 1 if n <= smallest else min(n, 8, max(2, math.ceil(math.sqrt(n))))


def _count_of(n: Column, smallest: int = 2) -> Column:
    return F.when(n <= smallest, 1).otherwise(F.least(n, F.lit(8), F.greatest(F.lit(2), F.ceil(F.sqrt(n)))))


def merged_in_order(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges of clusters, ascending by id, as (first member, the other's first member, mean cosine distance): the nearest
    pair first, ties by first members. A matrix of their distances is kept with each row's nearest."""
    m = len(ids)
    dist = np.round(1 - (sums @ sums.T) / np.outer(sizes, sizes), DECIMALS)
    np.fill_diagonal(dist, np.inf)
    exact, size = 1 - (sums @ sums.T) / np.outer(sizes, sizes), sizes.astype(float).copy()
    upper = np.where(np.triu(np.ones((m, m), bool), 1), dist, np.inf)
    near, least = upper.argmin(axis=1), upper.min(axis=1)
    out = []
    for _ in range(m - 1):
        i = int(least.argmin())
        j = int(near[i])
        out.append((int(ids[i]), int(ids[j]), float(least[i])))
        exact[i] = (size[i] * exact[i] + size[j] * exact[j]) / (size[i] + size[j])
        exact[:, i] = exact[i]
        size[i] += size[j]
        row = np.round(exact[i], DECIMALS)
        upper[i, i + 1 :] = np.where(np.isinf(upper[i, i + 1 :]), np.inf, row[i + 1 :])
        upper[:i, i] = np.where(np.isinf(upper[:i, i]), np.inf, row[:i])
        upper[j], upper[:, j] = np.inf, np.inf
        least[j], near[j] = np.inf, -1
        closer = np.flatnonzero(np.isfinite(upper[:i, i]) & (upper[:i, i] <= least[:i]))
        for k in {i, *np.flatnonzero((near == j) | (near == i)).tolist(), *closer.tolist()}:
            near[k] = upper[k].argmin()
            least[k] = upper[k, near[k]]
    return out


def labels_of(ids: np.ndarray, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Cluster numbers, by first member, after all but the last k - 1 merges."""
    up = {int(i): int(i) for i in ids}
    for a, b, _ in merges[: len(ids) - k]:
        up[b] = a
    roots = []
    for i in ids.tolist():
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        roots.append(i)
    names = {r: n for n, r in enumerate(sorted(set(roots)))}
    return np.array([names[r] for r in roots], np.int32)


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def merged_within(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray, beyond: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges, as places in ``ids`` (ascending), that the rest of the group can't change; in the order in which they are made.

    No cluster outside is nearer than ``beyond`` to any of these, so a merged one is no nearer to what is outside than the mean of its
    parts' bounds. Two that are each other's nearest here and nearer than both bounds merge; others stay as they are, and so
    do those whose nearest one stays. ``sure`` is the place of the one that is each other's nearest in the whole group, or -1."""
    m, out = len(ids), []
    exact, size, beyond = 1 - (sums @ sums.T) / np.outer(sizes, sizes), sizes.astype(float), beyond.astype(float)
    dist = np.round(exact, DECIMALS)
    np.fill_diagonal(dist, np.inf)
    near = dist.argmin(axis=1)
    least, stays, whole = dist[np.arange(m), near], np.zeros(m, bool), np.ones(m, bool)
    while np.isfinite(least.min()):
        i = int(least.argmin())
        j, d = int(near[i]), least[i]
        proven = d < min(beyond[i], beyond[j]) - 2 * 10.0**-DECIMALS or (whole[i] and whole[j] and sure[i] == j)
        if stays[j] or near[j] != i or not proven:
            least[i], stays[i] = np.inf, True
            continue
        i, j = min(i, j), max(i, j)
        out.append((i, j, float(d)))
        exact[i] = (size[i] * exact[i] + size[j] * exact[j]) / (size[i] + size[j])
        exact[:, i] = exact[i]
        both = size[i] * beyond[i], size[j] * beyond[j]
        size[i] += size[j]
        beyond[i], whole[i], whole[j] = sum(both) / size[i], False, False
        row = np.where(np.isinf(dist[i]), np.inf, np.round(exact[i], DECIMALS))
        row[j] = np.inf
        dist[i], dist[:, i], dist[j], dist[:, j] = row, row, np.inf, np.inf
        least[j], stays[j] = np.inf, True
        for k in {i, *np.flatnonzero(((near == i) | (near == j)) & ~stays).tolist()}:
            near[k] = dist[k].argmin()
            least[k] = dist[k, near[k]]
    # a pair that rounding kept apart here
    out += [(i, int(j), float(dist[i, j])) for i, j in enumerate(sure) if i < j and whole[i] and whole[j]]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys, as they come; one that goes over batches comes in pieces."""
    for b in batches:
        if b.num_rows == 0:
            continue
        codes = [b.column(k).dictionary_encode().indices.to_numpy() for k in keys]
        starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            yield tuple(b.column(k)[lo].as_py() for k in keys), b.slice(lo, hi - lo)


def _arrays(pieces: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, counts and sums."""
    ids, n = (np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in ("id", "n"))
    return ids, n, np.concatenate([p.column("s").flatten().to_numpy().reshape(p.num_rows, -1) for p in pieces])


def _listed(asked: tuple, base: tuple, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, places, distances, bounds): for each asked cluster its nearest ones of a block, at most so many, in order of distance and
    id; no other one of the block is nearer than the bound. Single precision tells which ones to measure: what is left
    out is beyond the last of them by all but its error, and where that decides nothing the whole block is measured."""
    (ids, n, s), (others, m, t) = asked, base
    rough = (s / n[:, None]).astype(np.float32) @ (t / m[:, None]).astype(np.float32).T
    order = np.argsort(others)
    at = order[np.minimum(np.searchsorted(others, ids, sorter=order), len(others) - 1)]
    own = others[at] == ids
    rough[own, at[own]] = -np.inf
    few = len(others) <= most + 1
    least = np.full(len(ids), -3.0) if few else np.partition(rough, len(others) - most - 1, axis=1)[:, len(others) - most - 1].astype(float)
    measured = lambda r, c: np.round(1 - np.einsum("ij,ij->i", s[r], t[c]) / (n[r] * m[c]), DECIMALS)
    r, c = np.nonzero(rough >= least[:, None])
    d = measured(r, c)
    bound = np.full(len(ids), np.inf) if few else 1 - least - (s.shape[1] + 8) * 2.0**-23 - 10.0**-DECIMALS
    good = np.isfinite(d) & (d < bound[r])
    r, c, d = r[good], c[good], d[good]
    found = np.bincount(r, minlength=len(ids))
    for i in np.flatnonzero((found == 0) & ~few):
        cols = np.flatnonzero(others != ids[i])
        dist = measured(np.full(len(cols), i), cols)
        cols, dist = cols[np.isfinite(dist)], dist[np.isfinite(dist)]
        first = np.lexsort((others[cols], dist))[: most + 1]
        r, c, d = np.append(r, np.full(len(first), i)), np.append(c, cols[first]), np.append(d, dist[first])
        bound[i] = np.inf
    first = np.lexsort((others[c], d, r))
    r, c, d = r[first], c[first], d[first]
    found = np.bincount(r, minlength=len(ids))
    place = np.arange(len(r)) - (np.cumsum(found) - found)[r]
    bound[r[place == most]] = np.minimum(bound[r[place == most]], d[place == most])
    keep = place < most
    return np.minimum(found, most), c[keep], d[keep], bound


def _nearest(asked: DataFrame, clusters: DataFrame, by: str, kind: str, block: int, most: int) -> DataFrame:
    """(by, id, near, beyond): of each asked cluster the nearest ones of its group, (d, id, n) in this order, ``most`` at most, and a distance
    that all others reach. Clusters are dealt into blocks by a hash; the asked ones go to each block of their group, follow its
    clusters there row by row, and a list for each of them and block comes back."""
    sizes = F.broadcast(clusters.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    base = clusters.join(sizes, by).select(by, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "id", "n", "s")
    queries = asked.join(sizes, by).select(by, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "n", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, base = None, [], None
        for (group, number, asks), rows in _runs(batches, [by, "block", "asks"]):
            if at != (group, number):
                at, pieces, base = (group, number), [], None
            if not asks:
                pieces.append(rows)
                continue
            if pieces:
                base, pieces = _arrays(pieces), []
            for lo in range(0, rows.num_rows if base else 0, 512):
                part = rows.slice(lo, 512)
                counts, places, d, beyond = _listed(_arrays([part]), base, most)
                near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(d), pa.array(base[0][places]), pa.array(base[1][places])], ["d", "id", "n"]))
                yield pa.RecordBatch.from_arrays([part.column(by), part.column("id"), near, pa.array(beyond)], [by, "id", "near", "beyond"])

    dealt = base.unionByName(queries).repartition(by, "block").sortWithinPartitions(by, "block", "asks")
    found = dealt.mapInArrow(run, f"`{by}` {kind}, id long, near array<struct<d: double, id: long, n: long>>, beyond double")
    found = found.groupBy(by, "id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"), F.min("beyond").alias("beyond"))
    # the first is the nearest of all, even where others may be as near
    found = found.withColumn("near", F.filter("near", lambda x, i: (i == 0) | (x["d"] < F.col("beyond"))))
    return found.select(by, "id", F.slice("near", 1, most).alias("near"), F.least("beyond", F.get("near", F.lit(most))["d"]).alias("beyond")).where(F.size("near") > 0)


def _parts(near: DataFrame, by: str, most: int) -> DataFrame:
    """(id, part): clusters that lead to the same one when each goes on to its nearest one, a few steps far; ``most`` of a part, the
    nearest, and none that is alone. Pairs that are each other's nearest are together."""
    to = near.select("id", F.col("near")[0]["id"].alias("to"), F.col("near")[0]["d"].alias("d"))
    back = to.select(F.col("id").alias("to"), F.col("to").alias("back"))
    pair = F.coalesce(F.col("back") == F.col("id"), F.lit(False))
    to = cut(to.hint("merge").join(back, "to", "left").select("id", "d", pair.alias("pair"), F.when(pair, F.least("id", "to")).otherwise(F.col("to")).alias("part")), "pointed")
    step = to.select(F.col("id").alias("part"), F.col("part").alias("next"))
    led = to
    for _ in range(2):
        led = led.hint("merge").join(step, "part", "left").select("id", "d", "pair", F.coalesce("next", "part").alias("part"))
    w = Window.partitionBy("part")
    led = led.withColumn("_n", F.row_number().over(w.orderBy(F.desc("pair"), "d", "id"))).where(F.col("_n") <= most)
    out = led.select("id", "part", F.count("*").over(w).alias("_of")).where("_of > 1").drop("_of")
    out.pointed = to
    return out


def _merged(members: DataFrame, by: str, kind: str, number: int) -> DataFrame:
    """(part, by, id, n, s, near, beyond) -> (by, id, n, s, members, merges): the new clusters of every part, what they are made of and how."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []

        def part(rows: list[pa.RecordBatch]) -> None:
            ids, n, s = _arrays(rows)
            ends = np.cumsum(np.concatenate([pc.list_value_length(r.column("near")).to_numpy() for r in rows]))
            near = [r.column("near").flatten() for r in rows]
            d, other, m = (np.concatenate([x.field(f).to_numpy() for x in near]) for f in ("d", "id", "n"))
            beyond = np.concatenate([r.column("beyond").to_numpy() for r in rows])
            # one of the same id that has grown is another one
            place = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
            inside = (ids[place] == other) & (n[place] == m)
            out = np.append(np.flatnonzero(~inside), len(d))
            starts = np.append(0, ends[:-1])
            outer = out[np.searchsorted(out, starts)]
            bound = np.where(outer < ends, np.append(d, np.inf)[outer], beyond)
            first = np.where(inside[starts], place[starts], -1)
            sure = np.where((first >= 0) & (first[first] == np.arange(len(ids))), first, -1)
            s, n, of, how = s.copy(), n.copy(), {}, {}
            for step, (i, j, at) in enumerate(merged_within(ids, s, n, bound, sure)):
                s[i] += s[j]
                n[i] += n[j]
                of[i] = of.get(i, [int(ids[i])]) + of.pop(j, [int(ids[j])])
                how[i] = how.get(i, []) + how.pop(j, []) + [{"lo": int(ids[i]), "hi": int(ids[j]), "d": at, "round": number << 12 | min(step, 4095)}]
            group = rows[0].column(by)[0].as_py()
            made.extend({by: group, "id": int(ids[i]), "n": int(n[i]), "s": s[i], "members": of[i], "merges": how[i]} for i in of)

        at, rows = None, []
        for (key,), piece in _runs(batches, ["part"]):
            if key != at and rows:
                part(rows)
                rows = []
            at = key
            rows.append(piece)
            if len(made) > 4096:
                yield pa.RecordBatch.from_pylist(made, schema)
                made.clear()
        if rows:
            part(rows)
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    ddl = f"`{by}` {kind}, id long, n long, s array<double>, members array<long>, merges array<struct<lo: long, hi: long, d: double, round: int>>"
    merge = pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("d", pa.float64()), ("round", pa.int32())])
    schema = pa.schema([(by, to_arrow_type(members.schema[by].dataType)), ("id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("members", pa.list_(pa.int64())), ("merges", pa.list_(merge))])
    return members.repartition("part").sortWithinPartitions("part", "id").mapInArrow(run, ddl)


def _rounds(clusters: DataFrame, by: str, kind: str, alone: int, block: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Clusters of large groups merged until ``alone`` are left in each or less, and the merges of each round.

    Of each cluster the nearest ones are kept. No merge comes nearer than its parts were, so what is listed before the first one that
    is gone, or has grown, still holds; a round asks only for new clusters and those whose nearest one is gone. Clusters that lead to each
    other are then merged in one task as far as their lists prove that no other one comes between: a cluster that takes
    in its neighbours one by one does so in a few rounds. Joins are never broadcast but for a row a group."""
    spark = clusters.sparkSession
    done: list[DataFrame] = []
    near: DataFrame | None = None
    total = clusters.count()
    while True:
        sized = F.broadcast(clusters.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > alone).select(by))
        if sized.isEmpty():
            return clusters, done
        large = clusters.join(sized, by, "left_semi")
        asked = large if near is None else large.hint("merge").join(near.select("id"), "id", "left_anti")
        # lists may be longer where few are asked for
        few = near is not None and asked.count() * 16 <= total
        found = _nearest(asked, large, by, kind, block, most * 16 if few else most)
        near_now = cut(found if near is None else found.unionByName(near.join(sized, by, "left_semi")), "nearest")
        parts = _parts(near_now, by, max(alone, 2))
        members = parts.hint("merge").join(large, "id").hint("merge").join(near_now.drop(by), "id")
        new = cut(_merged(members, by, kind, len(done) + 1), "new")
        if new.isEmpty():
            raise ValueError("vectors have to be finite")
        done.append(new.select(by, F.explode("merges").alias("m")).select(by, "m.*"))
        gone = new.select(F.explode("members").alias("id"))
        rest = clusters.hint("merge").join(gone, "id", "left_anti").unionByName(new.select(by, "id", "n", "s"))
        kept = near_now.hint("merge").join(gone, "id", "left_anti")
        kept = kept.withColumn("to", F.col("near")[0]["id"]).hint("merge").join(gone.withColumnRenamed("id", "to"), "to", "left_anti").drop("to")
        old = [t for t in (clusters, near) if t is not None and hasattr(t, "cut_path")]
        clusters, near = cut(rest, "clusters"), cut(kept.select(near_now.columns), "nearest")
        discard(spark, near_now, parts.pointed, *old)


def _copies(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a group as one cluster, and the merges that make it: their distance is 0, and no other pair's is less. Zero
    vectors stay as they are."""
    some = F.exists("s", lambda x: x != 0)
    firsts = rows.where(some).groupBy(by, "s").agg(F.min("id").alias("lo"), F.sum("n").alias("n"))
    merges = rows.where(some).join(firsts.where("n > 1").drop("n"), [by, "s"]).where("id > lo").select(by, "lo", F.col("id").alias("hi"), F.lit(0.0).alias("d"), F.lit(0).alias("round"))
    times = lambda s, n: F.transform(s, lambda x: x * n)
    return firsts.select(by, F.col("lo").alias("id"), "n", times("s", F.col("n")).alias("s")).unionByName(rows.where(~some)), merges


def clusters(vectors: DataFrame, by: str, alone: int = ALONE, block: int = BLOCK, most: int = LISTED) -> DataFrame:
    """(by, id long, v) -> (by, id, cluster): agglomerative clusters of every group by average linkage of cosine distances, of
    all rows at any size; numbered by first member (smallest id).

    The mean distance of two clusters of unit vectors is 1 - s.t / (n m) with the sums s, t of their vectors, so a cluster is a
    row of a sum and a count. Groups of more than ``alone`` are merged in rounds of Spark jobs until so many clusters are left;
    a task then merges these to the end. Average linkage never merges nearer after farther, so that all but the last merges of
    a group are its clusters, whatever was merged first. Copies are one cluster from the start. A round compares the clusters it
    has to ask for with all of their group, in blocks of ``block``, and keeps the ``most`` nearest: exact linkage is quadratic in
    a group, and no row for a pair ever leaves a task.

    Distances count to nine decimals; of equal ones the pair whose first members are smallest merges first. Zero vectors are at
    distance 1 from all. Ids have to be unique, rows without an id or a vector aren't clustered; an empty table gives no row.
    """
    kind = vectors.schema[by].dataType.simpleString()
    vectors = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = vectors.select(by, F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"), _unit(F.col("v").cast("array<double>")).alias("s"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    small, large = rows.join(sizes.where(F.col("_n") <= alone), by, "left_semi"), rows.join(sizes.where(F.col("_n") > alone), by, "left_semi")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x = pdf["id"].to_numpy(), np.array(pdf["s"].tolist(), float)
        return pd.DataFrame({by: pdf[by], "id": ids, "cluster": labels_of(ids, merged_in_order(ids, x, np.ones(len(ids))), cluster_count(len(ids)))})

    out = small.groupBy(by).applyInPandas(whole, f"`{by}` {kind}, id long, cluster int")
    if large.isEmpty():
        return out

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = merged_in_order(pdf["id"].to_numpy(), np.array(pdf["s"].tolist(), float), pdf["n"].to_numpy())
        return pd.DataFrame([(pdf[by].iloc[0], a, b, d, (1 << 30) + i) for i, (a, b, d) in enumerate(found)], columns=[by, "lo", "hi", "d", "round"])

    whole_rows = cut(large, "vectors")
    distinct, copies = _copies(whole_rows, by)
    left, merges = _rounds(cut(distinct, "clusters"), by, kind, alone, block, most)
    all_of = left.groupBy(by).applyInPandas(rest, f"`{by}` {kind}, lo long, hi long, d double, round int")
    for m in [copies, *merges]:
        all_of = all_of.unionByName(m)
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("d"), F.desc("round"), F.desc("lo"), F.desc("hi")))
    all_of = cut(all_of, "merges")
    top = all_of.withColumn("_last", last).where(F.col("_last") <= 7).join(sizes, by).where(F.col("_last") < _count_of(F.col("_n"))).select("lo", "hi")
    roots = components(all_of.join(F.broadcast(top), ["lo", "hi"], "left_anti").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    named = large.select(by, "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = named.select(by, "root").distinct().withColumn("cluster", (F.row_number().over(Window.partitionBy(by).orderBy("root")) - 1).cast("int"))
    return out.unionByName(named.join(firsts, [by, "root"]).select(by, "id", "cluster"))
