"""Answers, files, labels and lookups: what the tables don't hold."""

import pytest
import random
from difflib import SequenceMatcher
from pyspark.sql import functions as F

from litlake import flow
from litlake.operators import classify, evidence, pdf, reports, summaries, validation as v
from litlake.sources import lookups, runs, sinks


def errors(spark, answer, schema):
    return spark.range(1).select(v.schema_errors(v.parsed(F.lit(answer)), schema).alias("e")).first()["e"]


def test_types_enumerations_and_paths(spark):
    assert errors(spark, '{"a": 1}', v.record({"a": "string"})) == ["$.a: expected string, got int"]
    assert errors(spark, "[]", v.record({"a": "string"})) == ["$: expected object, got list"]
    assert errors(spark, "no json", v.record({"a": "string"})) == ["$: expected object, got NoneType"]
    assert errors(spark, '{"a": true}', v.record({"a": "number"})) == ["$.a: expected number, got bool"]
    assert errors(spark, '{"a": 1.5}', v.record({"a": "integer"})) == ["$.a: expected integer, got float"]
    assert errors(spark, '{"a": null}', v.record({"a": "null"})) == []
    nested = v.record({"rows": {"type": "array", "items": v.record({"t": "string"})}})
    assert errors(spark, '{"rows": [{"t": "x"}, {"u": 1}]}', nested) == ["$.rows[1].t: missing required field", "$.rows[1].u: unexpected field"]


def test_answers_are_repaired_and_checked(spark):
    row = spark.range(1).select(v.repaired_analysis(F.lit('{"methods": "x", "confidence": "sure", "core_findings": ["a"]}'), "pdf_text").alias("r")).first()["r"]
    assert (row["methods"], row["confidence"], row["core_findings"], row["source_basis"], row["research_problem"]) == ([], "low", ["a"], "pdf_text", "")
    domain = spark.range(1).select(v.repaired_synthesis(F.lit("{}"), "d").alias("r")).first()["r"]
    assert domain["domain"] == "d" and domain["evidence_index"] == []
    full = "{" + ", ".join([*(f'"{k}": "x"' for k in v.PAPER_TEXTS[:5]), '"source_basis": "pdf_text"', '"confidence": "low"', *(f'"{k}": []' for k in v.PAPER_LISTS[:-1]), '"supporting_text": ["The  Cells", "never said by anyone", " "]']) + "}"
    df = spark.createDataFrame([(full, "Old the cells age", None, None)], "answer string, abstract string, extracted_text string, selected_chunks array<struct<text:string>>")
    out = v.checked_analyses(df).first()
    assert out["errors"] == [] and out["unsupported_supporting_text"] == ["never said by anyone"]
    assert spark.range(1).select(v.selected_text(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.lit(None).cast("string").alias("text")))).alias("t")).first()["t"] == "a\n"


def test_files(spark):
    def state(content, length=300_000):
        return spark.range(1).select(pdf.state(F.lit(content).cast("binary"), F.lit(length)).alias("s")).first()["s"]

    assert state(b"%PDF-1.4 Abstract") == "complete" and state(b"%PDF-1.4 Abstract", 5) == "too_small"
    assert state(b"<html>abstract") == "not_pdf" and state(b"%PDF-1.4 log in abstract") == "paywalled_or_incomplete"
    assert state(b"%PDF-1.4 text") == "missing_paper_markers" and state(None) == "missing_file"
    df = spark.createDataFrame([("A/B: c" + "x" * 300, "", "Nature Aging", "2020", ["Lee, A"], ["Uni, Dept"])], "title string, doi string, journal string, publish_date string, authors array<string>, institutions array<string>")
    name = df.select(pdf.file_name().alias("n")).first()["n"]
    assert name.startswith("（2020，NA）A_B_ cx") and name.endswith("（Lee，Uni）.pdf") and len(name) == 184
    assert [spark.range(1).select(F.lit("").alias("pdf_url"), c.alias("s")).first()["s"] for c in (pdf.gate(True), pdf.gate(False, True), pdf.gate(False, False, True), pdf.gate())] == ["metadata_only", "skipped", "dry_run", None]


def test_cluster_labels(spark):
    rows = spark.createDataFrame([(1, 1, "cell-cycle genes genes", "x"), (1, 2, "genes of mice", "y"), (2, 3, "paper", "Other"), (1, 4, "", "y")], "cluster int, id int, text string, subdomain string")
    got = {r["cluster"]: (r["papers"], r["label"], r["confidence"]) for r in classify.cluster_labels(rows).collect()}
    assert got == {1: (3, "Topic_Genes_Cell_Cycle_Mice", 0.83), 2: (1, "Topic_Other", 0.0)}
    assert {r["cluster"]: r["label"] for r in classify.cluster_labels(rows, "subdomain").collect()} == {1: "y", 2: "Topic_Other"}


def test_traces_take_the_last_paper_of_a_key(spark):
    papers = spark.createDataFrame([("d", 0, "p1", "Old Cells!", "a"), ("d", 1, "p2", "old cells", "b")], "domain string, ord int, paper_id string, title string, doi string")
    claims = spark.createDataFrame([("d", 0, i, "c", p) for i, p in enumerate(["Old Cells!", "old cells", "OLD: cells", "p1", "?"])], "domain string, item int, pos int, claim string, paper string")
    assert [r["doi"] for r in reports.trace(claims, papers).orderBy("pos").collect()] == ["a", "b", "b", "a", ""]


def test_greedy_distinct_is_order_dependent(spark):
    # 1 goes by 0's DOI; 2 shares only the title of 1, which went, and stays
    rows = spark.createDataFrame([(0, "10.1/a", "One"), (1, "10.1/A", "Two"), (2, "", "two"), (3, "", "TWO!"), (4, "", ""), (5, None, None)], "_ord int, doi string, title string")
    assert sorted(r["_ord"] for r in evidence.greedy_distinct(rows).collect()) == [0, 2, 4, 5]


def test_lookups_and_percentages(spark):
    body = '{"title": "T", "externalIds": null, "year": 2001, "authors": [{"name": "A"}], "citationCount": 4}'
    row = spark.createDataFrame([(body,)], "body string").select(F.from_json("body", lookups.ANSWERS["semantic-scholar"]).alias("a")).select(*[c.alias(k) for k, c in lookups.cleaned(lookups.RESOLVERS["semantic-scholar"](F.col("a"))).items()]).first()
    assert (row["title"], row["doi"], row["publish_date"], row["authors"], row["citation_count"], row["abstract"]) == ("T", None, "2001", ["A"], 4, None)
    assert summaries.percent_to_threshold(None) == 0.12 and summaries.percent_to_threshold(30) == 0.3
    with pytest.raises(ValueError):
        summaries.percent_to_threshold(101)


def test_stages_and_settings(spark, tmp_path):
    plan = flow.Plan.of(["pdf-download", "report"], ["agents=dry-run"])
    assert not plan.runs("pdf_download") and plan.runs("stats") and plan.mode("paper_agents") == "dry-run"
    assert plan.rows() == [("final_report", False, "default"), ("paper_agents", True, "dry-run"), ("pdf_download", False, "default")]
    for bad in (lambda: flow.Plan.of(["nothing"]), lambda: flow.Plan.of([], ["stats"]), lambda: flow.Plan.of(["pdf"], [], flow.CORE), lambda: flow.reference_limits(most=0)):
        with pytest.raises(ValueError):
            bad()
    assert flow.article_filter("a, b ,", min_citations=3).keywords == ("a", "b") and flow.reference_limits(12, 3) == (0.12, 3)
    (tmp_path / "rules.json").write_text('{"rules": [{"domain": " D ", "terms": ["x", " "]}, {"domain": "", "terms": ["y"]}]}')
    (tmp_path / "list.json").write_text('[{"domain": "E", "terms": ["z"]}]')
    assert runs.read_rules(spark, str(tmp_path / "rules.json")) == [("D", ("x",))] and runs.read_rules(spark, str(tmp_path / "list.json")) == [("E", ("z",))]
    (tmp_path / "env").write_text("# c\nA='1'\nexport B = two\nC=3\n")
    assert runs.read_settings(spark, str(tmp_path / "env"), {"C": "9"}) == {"A": "1", "B": "two", "C": "9"}


def test_runs_packages_and_reports(spark, tmp_path):
    for run in ("one", "two"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "domain_manifest.json").write_text('{"domain_name": "%s", "paper_count": 2}' % run)
        (tmp_path / run / "notes.txt").write_text("x")
    assert [r["files"] for r in runs.runs(spark, str(tmp_path)).collect()] == [1, 1]
    assert {r["domain_name"] for r in runs.read_packages(spark, str(tmp_path)).collect()} == {"one", "two"}
    df = spark.createDataFrame([(1, "a", None), (2, None, ["x", "y"])], "rank int, title string, authors array<string>")
    sinks.write_ranking(df, df.limit(1), str(tmp_path / "out"))
    files = [f.read_text("utf-8") for f in sorted((tmp_path / "out/ranking").glob("part-*"))]
    assert all(f.startswith("\ufeffrank,title,authors\n") for f in files) and "2,,x; y\n" in "".join(files)
    assert spark.read.text(str(tmp_path / "out/summary")).first()[0] == '{"rank":1,"title":"a","authors":null}'


def test_calls_are_paced_and_tried_again():
    calls = []

    def fetch(address):
        calls.append(address)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert runs.paced(fetch, 0.0, 2, 0.01)("x") == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        calls.clear()
        runs.paced(fetch, 0.0, 1, 0.01)("x")


def test_snippets_near_the_limit(spark):
    """Sentences of a text with up to a fifth of their characters changed, against the ratio of every window."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("cell", "age", "mouse", "gene", "node") for b in ("s", "ing", "ed", "ly", "ic")]
    rows = []
    for i in range(60):
        text = ". ".join(" ".join(rng.choices(words, k=rng.randint(5, 12))) for _ in range(8))
        snippet = list(rng.choice(text.split(". ")))
        for _ in range(int(len(snippet) * rng.choice([0, 0.02, 0.05, 0.08, 0.12, 0.2]))):
            snippet[rng.randrange(len(snippet))] = rng.choice("abcdefgh xyz")
        rows.append((i, "".join(snippet), text))
    got = {r["i"] for r in evidence.ungrounded(spark.createDataFrame(rows, "i int, snippet string, text string")).select("i").collect()}

    def best(s, t):
        return max(SequenceMatcher(None, s, t[a : a + len(s)]).ratio() for a in range(0, max(1, len(t) - len(s) + 1), max(1, len(s) // 4)))

    plain = lambda s: " ".join(s.casefold().split())
    want = {i for i, s, t in rows if plain(s) and plain(s) not in plain(t) and best(plain(s), plain(t)) < 0.92}
    assert got == want and 5 < len(want) < 55
