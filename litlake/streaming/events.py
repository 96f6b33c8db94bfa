"""Run events as a stream: landing folders, windowed counts, and a breaker that stops asking sources that fail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their sum by type and tumbling window; state older than the watermark is dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends to Parquet; with ``once`` what is there is worked off and the query ends, to be resumed from its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def circuit_breaker(calls: DataFrame, most: int = 10) -> DataFrame:
    """(source, ts, ok) -> source, ts, ok, disabled: a source with ``most`` failures in a row is disabled for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values("ts")
        out = []
        for ok in rows["ok"]:
            run = run if run >= most else (0 if ok else run + 1)
            out.append(run >= most)
        state.update((run,))
        yield rows.assign(source=key[0], disabled=out)[["source", "ts", "ok", "disabled"]]

    return calls.groupBy("source").applyInPandasWithState(step, "source string, ts timestamp, ok boolean, disabled boolean", "run int", "append", GroupStateTimeout.NoTimeout)
