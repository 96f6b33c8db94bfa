"""Views over run events: the latest state and the last entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest_state(events: DataFrame, by: str, order: list[str], fields: list[str]) -> DataFrame:
    """Of each field the last value that isn't null. An aggregation, so a key with very many events is summed map-side."""
    at = F.struct(*order)
    return events.groupBy(by).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def last_events(events: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The last ``most`` of each key, newest first as ``place``; only so many rows of a key leave a task."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")
