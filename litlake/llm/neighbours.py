"""Nearest neighbours by inner product: multi-index hashing of learned, rotated binary codes, then exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import cut, sampled
from ._vectors import blocks, usable

NEIGHBOURS = 20
#: A code is made of PIECES substrings of 16 bits, each with an index.
PIECES = 16
BITS = 16 * PIECES
#: Vectors that the rotations are learned from, about; every row is indexed.
SAMPLE, ROUNDS, SEED = 8192, 12, 5
#: Rows of a block, which holds an index, and queries of one pass.
BLOCK, QUERIES = 8192, 1024
#: How many deviations of the Hamming distance, at the angle of the last neighbour found, the radius reaches beyond its mean.
MARGIN = 2.0

_ONES = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)
_FLIPS = [np.array([0], np.uint16), np.array([0, *(1 << i for i in range(16))], np.uint16)]


@dataclass
class Codes:
    """Rotations and the length that vectors are lifted to, so that nearest by angle is nearest by inner product."""

    rotation: np.ndarray
    top: float

    def of(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """Codes as substrings (rows, PIECES) of the vectors; rows of the base get a last component that makes lengths equal."""
        more = np.sqrt(np.maximum(self.top**2 - (x**2).sum(axis=1), 0)) if lift else np.zeros(len(x))
        bits = np.concatenate([x, more[:, None]], axis=1) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, top: float) -> Codes:
    """Orthogonal rotations, each turned step by step to where signs lose least of the sample (the Procrustes solution)."""
    rng = np.random.default_rng(SEED)
    lift = np.sqrt(np.maximum(top**2 - (sample**2).sum(axis=1), 0))
    x = np.concatenate([sample, lift[:, None]], axis=1)
    x = x / max(top, 1e-300)
    found, width = [], x.shape[1]
    while sum(r.shape[1] for r in found) < BITS:
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ v
        found.append(r)
    return Codes(np.concatenate(found, axis=1)[:, :BITS], top)


class Index:
    """Rows of a block by each of the substrings of their codes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, codes: Codes):
        self.x, self.ids, self.pieces = x, ids, np.ascontiguousarray(codes.of(x, lift=True).T)
        self.order = [np.argsort(p, kind="stable") for p in self.pieces]
        self.values, self.begin = zip(*(np.unique(p[o], return_index=True) for p, o in zip(self.pieces, self.order)))
        self.begin = [np.append(b, len(x)) for b in self.begin]

    def probe(self, code: np.ndarray, errors: int) -> np.ndarray:
        """Rows with at least one substring that differs from the code's in ``errors`` bits (0 or 1) or fewer."""
        hit = np.zeros(len(self.x), bool)
        for piece, values, begin, order in zip(code, self.values, self.begin, self.order):
            want = piece ^ _FLIPS[errors]
            at = np.minimum(np.searchsorted(values, want), len(values) - 1)
            at = at[values[at] == want]
            for b in at:
                hit[order[begin[b] : begin[b + 1]]] = True
        return np.flatnonzero(hit)

    def search(self, q: np.ndarray, own: int, code: np.ndarray, top: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``. By the pigeonhole principle every code within PIECES * (errors + 1) - 1 bits has a
        substring within ``errors``; the radius grows until it is MARGIN deviations past what the k-th angle leads to expect.
        Up to one error the buckets in reach are looked up. Beyond that there are more of them than rows, and more than have a
        row, so the rows that they hold are told by comparing each row's substrings, once for all further radii: the same
        rows, at less cost than going through the buckets."""
        length, errors, near = float(np.sqrt((q**2).sum())), 0, None
        while True:
            radius = PIECES * (errors + 1) - 1
            if errors < len(_FLIPS):
                rows = self.probe(code, errors)
                rows = rows[_ONES[self.pieces[:, rows] ^ code[:, None]].sum(axis=0, dtype=np.int64) <= radius]
            else:
                if near is None:
                    apart = _ONES[self.pieces ^ code[:, None]]
                    near, total = apart.min(axis=0), apart.sum(axis=0, dtype=np.int64)
                rows = np.flatnonzero((near <= errors) & (total <= radius))
            rows = rows[self.ids[rows] != own]
            score = (self.x[rows] * q).sum(axis=1)
            best = np.lexsort((self.ids[rows], -score))[:k]
            rows, score = rows[best], score[best]
            if radius >= BITS - 1:
                break
            errors += 1
            if len(rows) == k:
                share = np.arccos(np.clip(score[-1] / (length * top), -1, 1)) / np.pi
                due = BITS * share + MARGIN * np.sqrt(BITS * share * (1 - share))
                if radius >= due:
                    break
                errors = max(errors, int(np.ceil((due + 1) / PIECES)) - 1)
        return self.ids[rows], score


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by ``every`` its ``k`` nearest other rows by inner
    product in double precision, nearest first, ties to the smaller vec_id; all candidates where there are fewer.

    The scores are exact; that a neighbour is found is as likely as its code's distance is within MARGIN deviations of its mean,
    so of nearly equal far ones some may be missed. Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those of another length than most have. Repeated rows are candidates each, but rows with the
    query's own vec_id are not. Other columns are ignored. An empty table, or one without queries, gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    usual = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not usual:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = usual[0]["dim"]
    rows = rows.where(F.col("dim") == dim)
    top = rows.select(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 0.0
    sample = np.array([r["v"] for r in sorted(sampled(rows, "vec_id", SAMPLE).select("vec_id", "v").collect())], np.float64).reshape(-1, dim)
    codes = learn(sample, top)
    base = blocks(rows, ["dim"], "vec_id", BLOCK)
    base = cut(base.select(F.col("block").alias("part"), F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("x")), "base")
    asked = blocks(rows.where(F.col("vec_id") % every == 0), ["dim"], "vec_id", QUERIES)
    asked = cut(asked.select(F.col("block").alias("pass"), F.transform("rows", lambda r: r["vec_id"]).alias("q_ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("q")), "queries")
    passes = asked.count()
    # a stated query set against all rows, in blocks
    both = base.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(passes, 1) - 1)).cast("array<bigint>"))).repartition("part", "pass").join(asked, "pass")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part, ids, x, q_ids, q = (batch.column(c)[i] for c in range(5))
                if part.as_py() != last:
                    last, index = part.as_py(), Index(np.array(x.values.to_numpy(zero_copy_only=False)).reshape(-1, dim), np.array(ids.values.to_numpy(zero_copy_only=False)), codes)
                queries = np.array(q.values.to_numpy(zero_copy_only=False)).reshape(-1, dim)
                owners = q_ids.values.to_numpy(zero_copy_only=False)
                out_q, out_v, out_s = [], [], []
                for own, vector, code in zip(owners, queries, codes.of(queries, lift=False)):
                    found, score = index.search(vector, own, code, top, k)
                    out_q.append(np.full(len(found), own, np.int64))
                    out_v.append(found)
                    out_s.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    hits = both.select("part", "ids", "x", "q_ids", "q").mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
