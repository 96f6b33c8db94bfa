"""Works of an open API, page by page: a batch source that pushes filters into the request, and a stream that goes on at its cursor."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from .records import OPENALEX, openalex_articles

#: Fixed values of the public API: records of a page at most, and the cursor that asks for the first page.
PER_PAGE, FIRST = 200, "*"


@dataclass(frozen=True)
class Seed:
    """What one partition asks for: a journal by its ISSN, newest first, or a full-text search; years inclusive."""

    issn: str = ""
    search: str = ""
    first_year: int | None = None
    last_year: int | None = None

    @property
    def name(self) -> str:
        return self.issn or self.search

    def params(self, cursor: str, limit: int | None = None) -> dict[str, str]:
        wanted = [f"primary_location.source.issn:{self.issn}"] if self.issn else []
        wanted.append("type:article")
        if self.first_year is not None:
            wanted.append(f"from_publication_date:{self.first_year}-01-01")
        if self.last_year is not None:
            wanted.append(f"to_publication_date:{self.last_year}-12-31")
        out = {"filter": ",".join(wanted), "per-page": str(min(limit or PER_PAGE, PER_PAGE)), "cursor": cursor}
        return out | ({"search": self.search} if self.search else {"sort": "publication_date:desc"})

    def within(self, first: int | None, last: int | None) -> Seed:
        """The seed with its years narrowed."""
        firsts, lasts = [y for y in (self.first_year, first) if y is not None], [y for y in (self.last_year, last) if y is not None]
        return replace(self, first_year=max(firsts, default=None), last_year=min(lasts, default=None))


def _fetcher(path: str) -> Callable[[dict[str, str]], str]:
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


def _seeds(options: dict[str, str]) -> list[Seed]:
    return [Seed(**s) for s in json.loads(options["seeds"])]


def _page(text: str) -> tuple[list[dict], str]:
    """A page's works and the next one's cursor; empty where there is none."""
    body = json.loads(text)
    found = body.get("results") or []
    return found, ((body.get("meta") or {}).get("next_cursor") or "") if found else ""


class WorksSource(DataSource):
    """Rows (seed, page, place, publication_year, work), ``work`` the record as JSON.

    Options: ``seeds``, a JSON list of what ``Seed`` takes; ``fetch``, a function ``module:name`` from request parameters to a
    page's text, called on executors, so nothing here depends on a network; ``limit``, records of a seed at most. As a batch
    each seed is a partition that follows its cursor. As a stream each micro-batch is the next page of every seed; the offset
    holds each seed's cursor, page and records so far, so a query that is started again from its checkpoint goes on there.
    """

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "seed string, page int, place int, publication_year int, work string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Part(InputPartition):
    def __init__(self, seed: Seed):
        self.seed = seed


def _rows(seed: Seed, page: int, works: list[dict]) -> Iterator[tuple]:
    for place, w in enumerate(works):
        yield seed.name, page, place, w.get("publication_year"), json.dumps(w, ensure_ascii=False)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.first, self.last = options, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the publication year become part of the request; Spark keeps the other filters."""
        for f in filters:
            bound = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if isinstance(f, IsNotNull) and f.attribute == ("publication_year",):
                yield f
                continue
            if bound is None or f.attribute != ("publication_year",):
                yield f
                continue
            low, high = bound
            if low is not None:
                self.first = max(f.value + low, self.first if self.first is not None else f.value + low)
            if high is not None:
                self.last = min(f.value + high, self.last if self.last is not None else f.value + high)

    def partitions(self) -> list[_Part]:
        return [_Part(s.within(self.first, self.last)) for s in _seeds(self.options)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        fetch, seed = _fetcher(self.options["fetch"]), partition.seed
        limit = int(self.options["limit"]) if "limit" in self.options else None
        left, cursor, page = limit if limit is not None else 1 << 62, FIRST, 0
        ok = lambda y: (seed.first_year is None or y is not None and y >= seed.first_year) and (seed.last_year is None or y is not None and y <= seed.last_year)
        while cursor and left > 0:
            works, cursor = _page(fetch(seed.params(cursor, limit)))
            works = [w for w in works if ok(w.get("publication_year"))][:left]  # a date's year may differ from what was asked
            yield from _rows(seed, page, works)
            left, page = left - len(works), page + 1


class _Stream(SimpleDataSourceStreamReader):
    """Pages are small (``PER_PAGE`` records), and a cursor is known only from the page before, so that they are read one
    after another by whoever plans the batch, as many as there are seeds."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.fetch, self.limit = _fetcher(options["fetch"]), int(options["limit"]) if "limit" in options else None

    def initialOffset(self) -> dict:
        return {s.name: [FIRST, 0, 0] for s in _seeds(self.options)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for s in _seeds(self.options):
            cursor, page, count = start.get(s.name, [FIRST, 0, 0])
            if cursor and (self.limit is None or count < self.limit):
                works, cursor = _page(self.fetch(s.params(cursor, self.limit)))
                works = works if self.limit is None else works[: self.limit - count]
                rows += _rows(s, page, works)
                end[s.name] = [cursor, page + 1, count + len(works)]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that was planned but not done: the same pages again, by the cursors of the offset log."""
        now = dict(start)
        while any(now.get(k, [FIRST, 0, 0])[1] < v[1] for k, v in end.items()):
            behind = {k: v for k, v in now.items() if v[1] < end.get(k, v)[1]}
            ended = {s.name: ["", 0, 0] for s in _seeds(self.options)}
            rows, after = self.read(ended | behind)
            yield from rows
            now |= {k: after[k] for k in behind}


def articles_of(works: DataFrame) -> DataFrame:
    """The source's rows as articles, in the order of seed, page, place."""
    parsed = works.select(F.from_json("work", OPENALEX).alias("w"))
    return openalex_articles(parsed.select("w.*"))
