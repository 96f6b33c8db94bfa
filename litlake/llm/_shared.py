"""What several operators need: tables that cut lineage, row chunks, components of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..tables import cut, discard

#: Characters that one numpy pass works on; bounds a Python worker's memory, not what is processed.
CHUNK_CHARS = 1_000_000

def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows, by a hash of a key that few rows share: a filter by the counted size, so no task and no driver ever
    holds more than the sample."""
    share = max(1, -(-df.count() // most))
    return df.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0)


def text_chunks(column: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows with about ``most`` bytes of text each, and their texts; a longer text is a range of its own."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > most:
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if len(sizes) > begin:
        yield begin, len(sizes), column.slice(begin).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (id, root), root the smallest id that can be reached.

    Alternates "all larger neighbours point at the smallest neighbour" with "all smaller neighbours and the node point at
    the smallest" until nothing changes; each round is a table in the shared folder, where only the last one stays. Ids without
    an edge are not returned. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        last, now = now, cut(small.where("a <> b").distinct(), "small")
        discard(spark, last, large)
        # The sum of roots only falls, and stays once every id points at its root.
        mark = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
