"""Runs watched as streams: their latest state, last events and stalls, and batches that are written once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..tables import put_text, written

#: Events of a run that are kept, and shown newest first.
KEPT, SHOWN = 100, 20
#: State of ``transformWithState`` lives in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FIELDS = ("status", "stage", "message", "current_item", "processed", "total")
EVENT = "run string, seq long, ts timestamp, status string, stage string, message string, current_item string, processed long, total long, metric string, value string, event string"
STATE = "run string, seq long, ts timestamp, status string, stage string, message string, current_item string, processed long, total long, metrics map<string,string>, started_at timestamp, finished_at timestamp, events array<struct<seq:long,ts:timestamp,type:string,message:string>>, stalled boolean"
ENDED = ("completed", "failed")


class RunMonitor(StatefulProcessor):
    """Of each run: of every field the last value that isn't null, by (ts, seq); metrics merged name by name; its last ``KEPT``
    events; and, by a timer, that it has said nothing for ``quiet`` seconds while it was running.

    Updates may come late, out of order or twice: each field remembers when it was set, events are told apart by seq."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at = "ts timestamp, seq long"
        self.fields = handle.getMapState("fields", "name string", f"value string, {at}")
        self.metrics = handle.getMapState("metrics", "name string", f"value string, {at}")
        self.events = handle.getMapState("events", "seq long", "ts timestamp, type string, message string")
        self.marks = handle.getValueState("marks", "first timestamp, last timestamp, seq long, finished timestamp")

    @staticmethod
    def _put(state, name: str, value, ts, seq: int) -> None:
        old = state.getValue((name,)) if state.containsKey((name,)) else None
        if old is None or (old[1], old[2]) <= (ts, seq):
            state.updateValue((name,), (str(value), ts, seq))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, top, finished = self.marks.get() if self.marks.exists() else (None, None, -1, None)
        for frame in rows:
            for r in frame.to_dict("records"):
                ts, seq = r["ts"].to_pydatetime(), int(r["seq"])
                for f in FIELDS:
                    if not pd.isna(r[f]):
                        self._put(self.fields, f, int(r[f]) if f in ("processed", "total") else r[f], ts, seq)
                if not pd.isna(r["metric"]):
                    self._put(self.metrics, r["metric"], r["value"], ts, seq)
                if not pd.isna(r["event"]):
                    self.events.updateValue((seq,), (ts, r["event"], r["message"]))
                first = ts if first is None else min(first, ts)
                if last is None or (last, top) <= (ts, seq):
                    last, top = ts, seq
                if r["status"] in ENDED:
                    finished = ts if finished is None else max(finished, ts)
        kept = sorted(((v[0], k[0]) for k, v in self.events.iterator()), reverse=True)
        for _, seq in kept[KEPT:]:
            self.events.removeKey((seq,))
        self.marks.update((first, last, top, finished))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self._fields().get("status") not in ENDED:
            self.handle.registerTimer(int(pd.Timestamp(last, tz="UTC").timestamp() * 1000) + self.quiet * 1000)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._fields().get("status") not in ENDED:
            yield self._row(key, True)

    def _fields(self) -> dict[str, str]:
        return {k[0]: v[0] for k, v in self.fields.iterator()}

    def _row(self, key, stalled: bool) -> pd.DataFrame:
        first, last, seq, finished = self.marks.get()
        f = self._fields()
        events = sorted(((v[0], k[0], v[1], v[2]) for k, v in self.events.iterator()))
        number = lambda n: int(f[n]) if n in f else None
        row = {"run": key[0], "seq": seq, "ts": last, **{n: f.get(n) for n in ("status", "stage", "message", "current_item")}, "processed": number("processed"), "total": number("total"), "metrics": {k[0]: v[0] for k, v in self.metrics.iterator()}, "started_at": first, "finished_at": finished, "events": [{"seq": s, "ts": t, "type": kind, "message": m} for t, s, kind, m in events], "stalled": stalled}
        return pd.DataFrame([row]).astype({"processed": "Int64", "total": "Int64"})

    def close(self) -> None:
        pass


def watched(events: DataFrame, quiet: int = 600, late: str = "1 hour") -> DataFrame:
    """A stream of updates (EVENT) as a stream of states (STATE), one for each run and micro-batch that concerns it."""
    return events.withWatermark("ts", late).groupBy("run").transformWithStateInPandas(RunMonitor(quiet), STATE, "Update", "EventTime")


def run_states(events: DataFrame) -> DataFrame:
    """The same of a whole table of updates: STATE without ``stalled``, by aggregations that are summed map-side."""
    events = events.dropDuplicates(["run", "seq", "metric"])
    at = F.struct("ts", "seq")
    field = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n)
    rows = events.groupBy("run").agg(F.max(at).alias("last"), *map(field, FIELDS), F.min("ts").alias("started_at"), F.max(F.when(F.col("status").isin(*ENDED), F.col("ts"))).alias("finished_at"))
    metrics = events.where("metric IS NOT NULL").groupBy("run", "metric").agg(F.max_by("value", at).alias("value"))
    metrics = metrics.groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    w = Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("seq"))
    told = events.where("event IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= KEPT)
    entry = F.struct("ts", "seq", F.col("event").alias("type"), "message")
    told = told.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["seq"].alias("seq"), e["ts"].alias("ts"), e["type"].alias("type"), e["message"].alias("message"))).alias("events"))
    out = rows.join(metrics, "run", "left").join(told, "run", "left")
    empty = lambda n, kind: F.coalesce(n, kind).alias(n)
    return out.select("run", "last.seq", "last.ts", *FIELDS[:4], "processed", "total", empty("metrics", F.create_map().cast("map<string,string>")), "started_at", "finished_at", empty("events", F.array().cast("array<struct<seq:long,ts:timestamp,type:string,message:string>>")))


def upserts(key: str, path: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a table with the latest row of each ``key`` under ``path``, each batch once.

    A batch writes the merged table as a new version, then its ledger entry (batch id, version), which is what makes it count:
    readers and later batches go by the ledger. A batch that runs again finds its entry and does nothing; one that failed
    half-way left a version that no entry names, which the next run of it replaces."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = ledger(spark, path)
        if any(b >= batch_id for b, _ in entries):
            return
        before = upserted(spark, path)
        rows = batch if before is None else before.unionByName(batch)
        latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        version = f"batch={batch_id:010d}"
        rows.withColumn("_n", latest).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/versions/{version}")
        spark.createDataFrame([(batch_id, version)], "batch long, version string").coalesce(1).write.mode("overwrite").json(f"{path}/ledger/{version}")

    return upsert


def ledger(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Batches that count: (batch id, version), in order; a row for each batch."""
    if not written(spark, f"{path}/ledger"):
        return []
    rows = spark.read.option("recursiveFileLookup", "true").schema("batch long, version string").json(f"{path}/ledger").orderBy("batch").collect()
    return [tuple(r) for r in rows]


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table after the last batch that counts."""
    entries = ledger(spark, path)
    return spark.read.parquet(f"{path}/versions/{entries[-1][1]}") if entries else None


class Progress(StreamingQueryListener):
    """Other streams as runs: their beginning, each micro-batch and their end become updates (EVENT), a JSON file each in a
    folder that ``watched`` reads as a stream. A query is a run by its name, else its id; seq orders its updates."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _tell(self, run: str, seq: int, status: str, message: str, processed: int | None = None, event: str | None = None, metric: str | None = None, value: str | None = None) -> None:
        row = {"run": run, "seq": seq, "ts": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "status": status, "stage": "stream", "message": message, "processed": processed, "metric": metric, "value": value, "event": event}
        put_text(self.spark, f"{self.path}/{uuid.uuid4().hex}.json", json.dumps({k: v for k, v in row.items() if v is not None}))

    def onQueryStarted(self, event) -> None:
        self.names = getattr(self, "names", {}) | {str(event.id): event.name or str(event.id)}
        self._tell(self.names[str(event.id)], -1, "running", "started", event="started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell(p.name or str(p.id), p.batchId, "running", f"batch {p.batchId}", p.numInputRows, metric="rows", value=str(p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name, failed = getattr(self, "names", {}).get(str(event.id), str(event.id)), event.exception is not None
        self._tell(name, 1 << 62, "failed" if failed else "completed", (event.exception or "ended").split("\n")[0], event="failed" if failed else "completed")


def write_status(states: DataFrame, path: str) -> None:
    """The states as JSON, a folder for each run; runs that aren't among them keep theirs."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)
