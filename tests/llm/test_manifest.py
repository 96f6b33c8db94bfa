"""The Merkle manifest against plain hashing, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from litlake.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def tree(leaves, arity=3):
    """The levels of a tree from its leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i : i + arity]) for i in range(0, len(now), arity)])
    return levels


def plain(rows):
    out = []
    first = lambda v: (v is not None, v)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (first(r[0]), leaf(r))) for s in sources}
    low = {s: tree([leaf(r) for r in kept[s]]) for s in sources}
    high = tree([low[s][-1][0] for s in sources])
    for n, s in enumerate(sources):
        for at, r in enumerate(kept[s]):
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            now, others = leaf((*r[:4], text)), []
            for levels, i in ((low[s], at), (high, n)):
                for level in levels[:-1]:
                    run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
                    others += [level[j] for j in run if j != i]
                    now = sha(*(now if j == i else level[j] for j in run))
                    i //= 3
            out.append((r[0], leaf(r), low[s][-1][0], high[-1][0], sha(*others), now, now == high[-1][0]))
    return sorted(out, key=repr)


ROWS = [(i, ("a", "é", None, "hot")[min(i % 7, 3)], "en", i, f"text {i}\n" * (i % 3), "clash") for i in range(150)]
ROWS += [(i, f"z{i}", None, None, "one\ntwo", "clash") for i in range(200, 220)] + [(7, "hot", "en", 7, "again\n", "x")] * 9
ROWS += [(None, "hot", None, None, None, None), (None, None, None, None, "a\nb", None), (300, "", "", 0, "", ""), (301, "long", "en", 1, "x\n" * 200_000, "")]


@pytest.mark.parametrize("fragment, fan", [(5, 2), (8192, 64), (1, 3)])
def test_equals_plain_hashing(spark, fragment, fan):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    from pyspark.sql import functions as F

    bare = merkle.leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace("text", F.lit("\n"), F.lit(""))])
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, bare)
    out = merkle.verified(merkle.manifest(docs, tampered=other, fragment=fragment, fan=fan))
    assert sorted(map(tuple, out.collect()), key=repr) == plain(ROWS)


def test_audit_and_its_sql(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    got = sorted(map(tuple, merkle.audit(docs).collect()), key=repr)
    assert got == plain(ROWS) and {r[-1] for r in got} == {True, False}
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(merkle.duckdb_sql()).fetchall(), key=repr) == got


def test_few_rows(spark):
    docs = spark.createDataFrame(ROWS[:1], COLUMNS)
    one = merkle.audit(docs).first()
    assert one["root"] == one["subroot"] == one["leaf"] == leaf(ROWS[0]) and one["proof_sha256"] == sha()
    assert merkle.audit(docs.limit(0)).count() == 0
