import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from litlake.streaming import events, runs


def test_windows_resume_from_their_checkpoint(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=20 * i), "run", 1.0) for i in range(9)] + [(at + timedelta(days=5), "run", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), df.schema))
    for _ in range(2):
        events.append_to(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [r["n"] for r in got] == [3, 3, 3]


AT = datetime(2024, 1, 1)


def updates(n=260, seed=2):
    """Updates of three runs, some said twice, in no order; run c ends, b fails and goes on, a says nothing more."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        run = "abc"[i % 3] if i < 240 else "b"
        pick = lambda *xs: rng.choice(xs)  # noqa: B023, E731
        status = "running" if not (run == "c" and i == 239) and i != 100 else ("completed" if run == "c" else "failed")
        rows.append((run, i, AT + timedelta(seconds=i // 2), status, pick(None, "discover", "classify"), pick(None, f"m{i}"), pick(None, f"x{i}"), pick(None, i), pick(None, None, 500), pick(None, "pages", "hits"), str(i), pick(None, "source_error", "started")))
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    return rows


def plain(row):
    return {k: v for k, v in row.items() if k != "stalled"}


@pytest.fixture
def store(spark):
    for k, v in runs.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in runs.STORE:
        spark.conf.unset(k)


def test_a_watched_run_is_its_table(spark, store, tmp_path):
    rows, path = updates(), str(tmp_path / "in")
    os.mkdir(path)

    def land(part):
        spark.createDataFrame(part, runs.EVENT).coalesce(1).write.mode("append").parquet(path)

    def go():
        stream = runs.watched(spark.readStream.schema(runs.EVENT).option("maxFilesPerTrigger", 1).parquet(path), quiet=30)
        stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").json(f"{tmp_path}/out/{i:05d}")).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(150)

    land(rows[:100])
    land(rows[100:190])
    go()
    land(rows[190:])  # after a restart
    go()
    states = spark.read.schema("batch string, " + runs.STATE).option("recursiveFileLookup", "true").json(f"{tmp_path}/out").withColumn("batch", F.regexp_extract(F.input_file_name(), "/([0-9]{5})/", 1))
    last = states.where("NOT stalled").groupBy("run").agg(F.max_by(F.struct(*[F.col(c) for c in states.columns if c != "batch"]), "batch").alias("s")).select("s.*")
    got = {r["run"]: plain(r.asDict(True)) for r in last.collect()}
    want = {r["run"]: r.asDict(True) for r in runs.run_states(spark.createDataFrame(rows, runs.EVENT)).collect()}
    assert got == want and len(want) == 3 and len(want["b"]["events"]) <= runs.KEPT
    # time goes on elsewhere: the run that ended is quiet for good, the others are stalled
    spark.createDataFrame([("z", 0, AT + timedelta(hours=5), "running", *[None] * 8)], runs.EVENT).coalesce(1).write.mode("append").parquet(path)
    go()
    spark.createDataFrame([("z", 1, AT + timedelta(hours=5), "running", *[None] * 8)], runs.EVENT).coalesce(1).write.mode("append").parquet(path)
    go()
    stalled = spark.read.schema(runs.STATE).option("recursiveFileLookup", "true").json(f"{tmp_path}/out").where("stalled").select("run").distinct()
    assert {r["run"] for r in stalled.collect()} == {"a", "b"}


def test_only_the_last_hundred_events_are_kept(spark):
    rows = [("a", i, AT + timedelta(seconds=i), "running", *[None] * 7, "e") for i in range(130)]
    state = runs.run_states(spark.createDataFrame(rows, runs.EVENT)).first()
    assert [e["seq"] for e in state["events"]] == list(range(30, 130)) and state["metrics"] == {}


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert = runs.upserts("k", path, "at")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, at int, v string")
    assert runs.upserted(spark, path) is None
    upsert(batch(("a", 1, "a1"), ("b", 1, "b1")), 0)
    upsert(batch(("a", 3, "a3"), ("c", 1, "c1"), ("a", 2, "a2")), 1)
    want = {("a", 3, "a3"), ("b", 1, "b1"), ("c", 1, "c1")}
    table = lambda: {tuple(r) for r in runs.upserted(spark, path).collect()}
    assert table() == want
    upsert(batch(("a", 9, "other")), 1)  # replayed: its first run counts
    assert table() == want and [b for b, _ in runs.ledger(spark, path)] == [0, 1]
    with pytest.raises(Exception, match="stop"):  # fails half-way
        upsert(batch(("d", 1, "d1")).withColumn("v", F.raise_error(F.lit("stop"))), 2)
    assert table() == want
    upsert(batch(("d", 1, "d1"), ("b", 0, "old")), 2)
    assert table() == want | {("d", 1, "d1")}


def test_a_stream_through_the_ledger(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    rows = [(str(i % 5), i, f"v{i}") for i in range(20)]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, "k string, at int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, at int, v string").parquet(source)
        stream.writeStream.foreachBatch(runs.upserts("k", path, "at")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in runs.upserted(spark, path).collect()} == set(rows[15:])


def test_breaker_stays_open(spark, tmp_path):
    calls = [("a", AT + timedelta(seconds=i), ok) for i, ok in enumerate([False, False, True, False, False, False, True, True])] + [("b", AT, False)]
    schema = "source string, ts timestamp, ok boolean"
    spark.createDataFrame(calls, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = events.circuit_breaker(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)
    events.append_to(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("source", "ts").collect()
    assert [r["disabled"] for r in rows] == [False] * 5 + [True] * 3 + [False]


def test_a_stream_is_a_run_of_its_own(spark, tmp_path):
    """The listener's updates of a query that ends and of one that fails; their status files."""
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    spark.range(5).coalesce(1).write.parquet(source)
    listener = runs.Progress(spark, log)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(source)
        stream.writeStream.format("noop").queryName("good").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(90)
        with pytest.raises(Exception, match="stop"):
            bad = stream.select(F.raise_error(F.lit("stop")).alias("x"))
            bad.writeStream.format("noop").queryName("bad").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(90)
        end = time.time() + 30
        while time.time() < end and len([f for f in os.listdir(log) if f.endswith(".json")]) < 5:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    states = runs.run_states(spark.read.schema(runs.EVENT).json(log))
    got = {r["run"]: r for r in states.collect()}
    assert (got["good"]["status"], got["good"]["processed"], got["bad"]["status"]) == ("completed", 5, "failed")
    assert [e["type"] for e in got["good"]["events"]] == ["started", "completed"] and got["good"]["metrics"] == {"rows": "5"}
    for part in (states, states.where("run = 'bad'")):
        runs.write_status(part, str(tmp_path / "status"))
    assert {r["run"] for r in spark.read.json(str(tmp_path / "status")).select("run").collect()} == {"good", "bad"}
