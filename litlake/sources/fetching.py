"""Calls to outside services from tasks: bounded in flight, in order, paced by host, errors as rows."""

from __future__ import annotations

import importlib
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RESULT = "body string, error string"


def in_order[T, R](items: Iterable[T], call: Callable[[T], R], at_once: int) -> Iterator[tuple[R | None, str | None]]:
    """(result, None) or (None, error) of each item, in the items' order, with at most ``at_once`` calls begun and not yet
    answered for; the items are drawn no faster."""

    def answer(f: Future) -> tuple[R | None, str | None]:
        e = f.exception()
        return (f.result(), None) if e is None else (None, f"{type(e).__name__}: {e}")

    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque[Future] = deque()
        for item in items:
            if len(waiting) == at_once:
                yield answer(waiting.popleft())
            waiting.append(pool.submit(call, item))
        while waiting:
            yield answer(waiting.popleft())


class Pace:
    """Calls of one host begin at least ``pause`` seconds apart."""

    def __init__(self, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep, self.due = pause, clock, sleep, {}

    def wait(self, host: str) -> None:
        now = self.clock()
        at = max(now, self.due.get(host, now))
        self.due[host] = at + self.pause
        if at > now:
            self.sleep(at - now)


def fetched(requests: DataFrame, fetch: str, at_once: int = 8, pause: float = 0.0, tasks_of_host: int = 1) -> DataFrame:
    """(id, host, url, ...) -> the same rows with ``body`` and ``error``, one of which is null; ``fetch`` is ``module:function``
    from a url to text.

    A host's rows go to ``tasks_of_host`` tasks, dealt by id, each of which begins its calls of a host ``pause`` times as many
    seconds apart, so that the host is asked at that pace whatever the cluster's size; within a task rows keep the order of
    their ids. A task holds ``at_once`` answers, never its whole share. A call that fails is a row with its error; a null url
    is one too. A task that is lost asks again for its rows."""
    rows = requests.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(tasks_of_host)))
    rows = rows.repartition("host", "_part").sortWithinPartitions("id").drop("_part")
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), RESULT])
    place = [names.index(c) for c in ("host", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, function = fetch.partition(":")
        call, pace, held = getattr(importlib.import_module(module), function), Pace(pause * tasks_of_host), deque()

        def items() -> Iterator[tuple[str, str]]:
            for b in batches:
                held.append(b)
                hosts, urls = (b.column(i).to_pylist() for i in place)
                for host, url in zip(hosts, urls, strict=True):
                    pace.wait(host)
                    yield url

        def one(url: str | None) -> str:
            if url is None:
                raise ValueError("no url")
            return call(url)

        got: list[tuple[str | None, str | None]] = []
        for answer in in_order(items(), one, at_once):
            got.append(answer)
            if len(got) == held[0].num_rows:
                b = held.popleft()
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in zip(*got, strict=True))], [*names, "body", "error"])
                got = []
                while held and held[0].num_rows == 0:
                    held.popleft()

    return rows.mapInArrow(run, schema)
