"""The pipeline over a small corpus in which every stage has something to do."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from litlake.llm.packing import default_tokenizer

R = random.Random(11)


def prose(n):
    return ["".join(R.choices("etaoinshrdlu", k=R.randint(2, 8))) for _ in range(n)]


def test_each_stage_takes_effect_and_clean_documents_stay(spark, tmp_path):
    clean = {i: " ".join(prose(R.randint(60, 150))) + "." for i in range(60)}
    junk = {i: " ".join(w.upper() + "!!" for w in prose(60)) for i in range(60, 90)}
    passage = " ".join(prose(70))
    texts = clean | junk | {100: clean[1], 101: clean[2].rsplit(" ", 1)[0] + " other.", 102: " ".join(prose(40)) + " " + passage, 103: passage + " " + " ".join(prose(90)), 104: "write to a.b@c.example.com or +1 (555) 123-4567 " + " ".join(prose(50))}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    want = dict(clean)
    want[102] = texts[102]
    want[103] = texts[103].replace(passage, "", 1)
    want[104] = texts[104].replace("a.b@c.example.com", "<EMAIL>").replace("+1 (555) 123-4567", "<PHONE>")
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    slow = Tokenizer.from_file(default_tokenizer())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i, t in want.items():
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])])
        assert ids.tolist() == slow.encode(t, add_special_tokens=False).ids + [0]
    assert {r["doc_id"] for r in rows} == set(want)


def test_stages_take_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    text = " ".join(prose(80)) + "."
    other = " ".join(prose(80)) + "."
    rows = [(1, text), (1, text), (1, other), (2, None), (2, ""), (None, text), (3, " ".join(prose(20000)))]
    clash = "doc_id long, text string, n_chars long, score double, predicted int, spans string, masked string, whole string, t long, mark int, row long, _row long, _id long, _spans string, _cut string"
    docs = spark.createDataFrame([(i, t, len(t or ""), 0.5, 7, "s", "m", "w", 1, 2, 3, 4, 5, "x", "y") for i, t in rows], clash)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame, n in ((docs, [7, 6, 6, 6]), (docs.limit(0), [0] * 4)):
        for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], n):
            frame = stage(spark, frame, str(tmp_path))
            got = frame.collect()
            assert frame.columns == docs.columns and len(got) == want, name
            assert all(r["predicted"] == 7 and r["spans"] == "s" and r["_row"] == 4 for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 7
