"""Texts of any size: windows that are compared, rows that are held, and what moves between tasks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litlake.operators import evidence
from litlake.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_near_is_the_ratio_of_windows():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choices("abc é", k=rng.randrange(0, 60)))
        snippet = "".join(rng.choice([c, c, c, c, c, c, "z", ""]) for c in text[rng.randrange(20) :][: rng.randrange(1, 30)]) or "a"
        for least in (0.5, 0.8, 0.92, 0.995):
            assert evidence.near(snippet, text, least) == (evidence.window_ratio(snippet, text) >= least)


def test_windows_that_cannot_match_are_not_compared(monkeypatch):
    made, real = [], evidence.SequenceMatcher
    monkeypatch.setattr(evidence, "SequenceMatcher", lambda *a: made.append(1) or real(*a))
    assert not evidence.near("q7 0zxq 9vkj", "the quick brown fox jumps " * 4000, 0.92) and not made


def test_chunks_are_told_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(evidence, "HELD", 1000)
    kept = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: kept.setdefault("f", f))
    evidence.chunk_documents(spark.createDataFrame([(1, "x")], "id long, text string"))
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["One two. " * 50] * 50})
    sizes = [b.num_rows for b in kept["f"](iter([batch]))]
    assert sum(sizes) == 50 and max(sizes) <= 3


@pytest.mark.parametrize("name", ["inverted_abstract", "article_keywords"])
def test_words_stay_where_their_text_is(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")


def test_blank_texts_have_no_last_sentence(spark, tmp_path):
    import duckdb

    texts = ["", "   ", "\t\n", "\xa0\N{IDEOGRAPHIC SPACE}", None, "...", "One. Two", " a. "]
    rows = [(5 * n + k, t) for n, t in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.ORACLES["ungrounded_snippets"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["ungrounded_snippets"](spark, str(tmp_path)).collect()) == want == [(10,), (25,), (30,), (35,)]
