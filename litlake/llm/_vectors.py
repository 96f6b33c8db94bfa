"""Rows of vectors: which of them count, and blocks of them as matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(v: Column) -> Column:
    """True for vectors that aren't null, empty or zero and hold no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.Array | Sequence, dim: int) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    if isinstance(lists, pa.Array):
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.array(lists, np.float64).reshape(-1, dim)


def blocks(rows: DataFrame, keys: Sequence[str], id_col: str, size: int) -> DataFrame:
    """Rows of (keys, id_col, v, ...) in blocks of about ``size``: keys, block, ids and the arrays of v's components one after
    another. Rows are dealt by a hash of the id, by the counted size of their key; no key is gathered whole."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    dealt = rows.join(counts, list(keys)).withColumn("block", F.pmod(F.xxhash64(id_col), F.ceil(F.col("_size") / size)))
    return dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct(id_col, "v", *[c for c in rows.columns if c not in (*keys, id_col, "v")])).alias("rows"))
