"""What the sinks leave in their folders."""

import json
import os

from pyspark.sql import functions as F

from litlake.operators import summaries
from litlake.sources import records, sinks, star


def lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(f"{path}/{name}", encoding="utf-8") as f:
                out += f.read().splitlines()
    return out


REFS = "title string, doi string, journal string, publish_date string, abstract string, authors array<string>, citation_counts map<string,int>"


def refs(spark, n=3):
    return spark.createDataFrame([(f"T {i}", f"10.1/{i}", "", "2020-01", "a\nb", ["Lee, A", "Kim, B"], {"x": i}) for i in range(n)], REFS).coalesce(1)


def test_ris(spark, tmp_path):
    sinks.write_ris(refs(spark, 2), str(tmp_path / "r"))
    got = lines(tmp_path / "r")
    assert got[:7] == ["TY  - JOUR", "TI  - T 0", "AU  - Lee, A", "AU  - Kim, B", "PY  - 2020", "DO  - 10.1/0", "AB  - a b"] and got[7] == "ER  -" and got[9] == "TY  - JOUR"


def test_reference_bundle(spark, tmp_path):
    out = str(tmp_path / "b")
    sinks.write_references(refs(spark), spark.createDataFrame([(3, None)], "references int, note string"), out, 2)
    assert [json.loads(x)["doi"] for x in lines(f"{out}/manifest")] == ["10.1/0", "10.1/1", "10.1/2"]
    assert len(lines(f"{out}/candidates")) > 3 and lines(f"{out}/top")[0].startswith("﻿title,doi") and "citation_counts" not in lines(f"{out}/top")[0]
    assert [json.loads(x) for x in lines(f"{out}/summary")] == [{"references": 3, "note": None}]


def test_basic_stats_are_ordered(spark, tmp_path):
    counts = spark.createDataFrame([("journal", "b", 2), ("journal", "a", 2), ("journal", "c", 5), ("author", "z", 1)], "kind string, name string, count int")
    cited = spark.createDataFrame([("author", "z", 7), ("author", "y", 9)], "kind string, name string, citation_count long")
    sinks.write_basic_stats(counts, cited, str(tmp_path / "s"))
    got = [tuple(json.loads(x).values()) for x in lines(tmp_path / "s")]
    assert got == [("author_citation_ranking", "y", 9), ("author_citation_ranking", "z", 7), ("author_counts", "z", 1), ("journal_counts", "c", 5), ("journal_counts", "a", 2), ("journal_counts", "b", 2)]


def test_packages_and_bundle(spark, tmp_path):
    papers = spark.createDataFrame([("A", "t1"), ("B", "t2"), ("A", "t3")], "subdomain string, title string")
    sinks.write_packages(papers, str(tmp_path / "p"))
    assert sorted(d for d in os.listdir(tmp_path / "p") if "=" in d) == ["subdomain=A", "subdomain=B"]
    assert spark.read.json(str(tmp_path / "p")).where("subdomain = 'A'").count() == 2
    sinks.write_bundle({"one": papers, "two": papers.limit(1)}, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q/one")).count() == 3 and spark.read.parquet(str(tmp_path / "q/two")).count() == 1


def test_markdown(spark):
    rows = spark.createDataFrame([("a|b", 1), ("x" * 300, 2), ("c", 3)], "name string, n int").coalesce(1)
    got = sinks.markdown_table(rows, ["name", "n"], 2).split("\n")
    assert got[:2] == ["| name | n |", "| --- | --- |"] and len(got) == 4 and all(len(x) < 200 for x in got)


def test_cache_keys_providers_and_journals(spark):
    key = lambda u, p: spark.range(1).select(records.cache_key(F.lit(u), F.lit(p))).first()[0]
    assert key("u", "p") == key("u", "p") != key("p", "u") and len(key("u", "p")) == 64
    assert records.provider("OpenAlex") is records.openalex_articles and records.provider("CROSSREF") is records.crossref_articles
    try:
        records.provider("none")
    except KeyError as e:
        assert "none" in str(e)
    rows = records.journals_frame(spark, [records.Journal("k", "N", issn="1")])
    assert rows.first().asDict() == {"key": "k", "name": "N", "provider": "layered", "issn": "1", "slug": "", "group": ""}


def test_statistics_bundle(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    articles, references = star.articles(spark, "/root/testdata/sf0.001"), star.references(spark, "/root/testdata/sf0.001")
    sinks.write_statistics(summaries.statistics_bundle(articles, references, 2026, 5), str(tmp_path))
    names = {d for d in os.listdir(tmp_path)}
    assert len(names) == 17 and {"summary", "profile", "reference_insights", "year_trend", "topic_profiles"} <= names
    assert json.loads(lines(tmp_path / "summary")[0])["total_papers"] == articles.count()
    assert len(lines(tmp_path / "author_stats")) == 6 and lines(tmp_path / "top_papers")[0].endswith("title,doi,journal,year,subdomain,article_type,citation_count")
    assert lines(tmp_path / "reference_insights")[0].endswith("relevance_score,value_score,cited_by_source_papers")


def test_survey_report(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    bundle = summaries.statistics_bundle(star.articles(spark, "/root/testdata/sf0.001"), star.references(spark, "/root/testdata/sf0.001"), 2026, 5)
    domains = spark.createDataFrame([("b", "# b\n\n## Gaps\n- one"), ("a", "# a\n")], "domain string, report string")
    sinks.write_survey(bundle, domains, "Orders", str(tmp_path), 3)
    got = (tmp_path / "report.md").read_text().split("\n")
    heads = [x for x in got if x.startswith("#")]
    assert heads[:3] == ["# Orders", "## Overview", "## Papers by Year"] and heads[-4:] == ["## Read First", "## a", "## b", "### Gaps"]
    assert f"- Total papers: {bundle['summary'].first()['total_papers']}" in got
    at = got.index("## Authors")
    assert got[at + 2 : at + 4] == ["| author | paper_count | citation_count |", "| --- | --- | --- |"] and all(x.startswith("| ") for x in got[at + 4 : at + 7]) and got[at + 7] == ""
