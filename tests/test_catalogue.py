"""Every query against its SQL on the smallest tables."""

import os

import pytest

from litlake.plans import catalogue, flows, reports  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


def rows(frame):
    def cell(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(cell(v) for v in r) for r in frame), key=repr)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    out = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(out.select(columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
