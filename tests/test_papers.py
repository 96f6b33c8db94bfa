"""Fixtures of our own for what the tables don't hold: headings, DOIs, reviews, ties, missing values."""

import json

from pyspark.sql import functions as F

from litlake.functions import scoring, text as tx
from litlake.operators import classify, enrich, evidence, filters, linkage, monitor, ranking, references as refs, stats
from litlake.schema import normalise_articles
from litlake.sources import pages, records, sinks


def articles(spark, *rows):
    """Papers from dictionaries, as a manifest would give them."""
    kind = "_ord long, title string, doi string, journal string, publish_date string, article_type string, authors array<string>, institutions array<string>, abstract string, subdomain string, citation_count int, pdf_status string, local_pdf_path string, classification_source string"
    names = [c.split()[0] for c in kind.split(", ")]
    return normalise_articles(spark.createDataFrame([tuple({"_ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], kind))


def value(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_years_and_tokens(spark):
    assert value(spark, tx.extract_year(F.col("d")), d="2024/1/2") == "2024"
    assert value(spark, tx.extract_year(F.col("d")), d="n.d.") == ""
    assert value(spark, tx.tokens(F.col("t")), t="The Cell-cycle of AI and B12 data") == ["cell-cycle", "b12"]
    assert value(spark, tx.count_term(F.lower("t"), "age"), t="Age, ages; old age") == 2
    assert value(spark, tx.count_term(F.lower("t"), "old age"), t="old age of old ages") == 2
    assert value(spark, tx.clean_doi(F.col("d")), d=" https://dx.doi.org/10.1/Ab ") == "10.1/Ab"
    assert value(spark, tx.clean_abstract(F.col("d")), d="<jats:p>One\n two</jats:p>") == "One two"
    assert value(spark, tx.solution_summary(F.col("d")), d="A b. C d! E f?") == "C d! E f?"
    assert value(spark, tx.solution_summary(F.col("d")), d="") is None


def test_journal_tiers_by_name_then_first_part(spark):
    def tier(name):
        return value(spark, F.struct(*scoring.journal_tier(F.col("j"))), j=name)

    assert tuple(tier("Nature Aging")) == ("top_field", 0.86)
    assert tuple(tier("Materials Science Letters")) == ("top_general", 1.0)
    assert tuple(tier("")) == ("unmapped", 0.45)


def test_counts_trim_and_count_a_name_once_in_a_paper(spark):
    df = articles(spark, {"authors": ["Ann", " Ann ", "", "Bo"], "citation_count": 5}, {"authors": ["Bo"], "citation_count": None})
    got = {r["author"]: (r["paper_count"], r["citation_count"]) for r in stats.group_counts(df, F.col("authors"), "author", True).collect()}
    assert got == {"Ann": (1, 5), "Bo": (2, 5)}
    assert {r["name"]: r["count"] for r in stats.basic_rankings(df).where("kind = 'author'").collect()}["Bo"] == 2


def test_trends(spark):
    def trend(*years):
        return stats.topic_trends(articles(spark, *[{"subdomain": "x", "publish_date": y} for y in years])).first()["trend"]

    assert trend("", "n.d.") == "unknown"
    assert trend("2020", "2020-05") == "new"
    assert trend("2010", "2019", "2020") == "rising"
    assert trend("2010", "2011", "2020") == "declining"
    assert trend("2010", "2020") == "stable"


def test_keyword_ties_go_by_first_appearance_and_the_label_leads(spark):
    df = articles(spark, {"subdomain": "Topic_Zebra_Lion", "title": "walrus otter"}, {"subdomain": "Topic_Zebra_Lion", "title": "otter walrus lynx"})
    assert [r["token"] for r in stats.topic_keywords(df).orderBy("rank").collect()] == ["zebra", "lion", "walrus", "otter", "lynx"]


def test_summary_of_nothing(spark):
    row = stats.corpus_summary(articles(spark, {}).limit(0)).first()
    assert (row["total_papers"], row["median_citations"], row["unique_authors"]) == (0, 0.0, 0)


def test_filter_rules(spark):
    df = articles(spark, {"title": "Large language models in review", "publish_date": "2021", "article_type": "Review Article", "authors": ["Ann Lee"], "citation_count": None})
    f = filters.ArticleFilter
    hits = lambda **k: df.where(f(**k).column()).count()
    assert hits() == hits(keywords=["LLM", "review"]) == hits(article_types=["letter", "review"]) == hits(year=2021, from_year=1999, to_year=2000) == hits(authors=["lee", "x"]) == 1
    assert hits(keywords=["llm", "rocket"]) == hits(min_citations=1) == hits(institutions=["mit"]) == hits(to_year=2020) == 0


def test_quota_per_domain_takes_larger_domains_first(spark):
    rows = [{"title": f"p{i}", "doi": f"d{i}", "subdomain": s, "citation_count": c} for i, (s, c) in enumerate([("A", 1), ("A", 2), ("B", 50), ("B", 60)])]
    ranked = ranking.rank_for_download(articles(spark, *rows), 2024)
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert [r["title"] for r in ranking.select_papers(ranked, 1, 1).collect()] == ["p3"]
    assert ranking.select_papers(ranked, 0, 1).count() == 2 and ranking.select_papers(ranked, 0).count() == 0


def test_eligibility_reasons(spark):
    df = articles(spark, {"title": "a"}, {"title": "b", "doi": "x", "pdf_status": "complete", "local_pdf_path": "/p"}, {"title": "c", "doi": "y"})
    got = {r["title"]: r["eligibility_reason"] for r in ranking.rank_for_download(df, 2024).collect()}
    assert got == {"a": "missing_doi", "b": "already_complete", "c": "eligible"}


def references(spark, *rows):
    kind = "_ord long, pos long, source_doi string, source_title string, title string, doi string, journal string, publish_date string, abstract string, pdf_url string, authors array<string>, citation_count int"
    names = [c.split()[0] for c in kind.split(", ")]
    empty = dict.fromkeys(("source_doi", "source_title", "title", "doi", "journal", "publish_date", "abstract", "pdf_url"), "") | {"authors": []}
    return spark.createDataFrame([tuple({**empty, "_ord": 0, "pos": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], kind)


def test_pool_fills_blanks_but_keeps_the_first_count(spark):
    df = references(spark, {"doi": "X", "source_title": "s1", "citation_count": 3}, {"_ord": 1, "doi": " x", "title": "T", "source_title": "s2", "citation_count": 9}, {"title": ""})
    row = refs.pool(df).collect()
    assert len(row) == 1 and (row[0]["title"], row[0]["citation_count"], row[0]["source_article_count"]) == ("T", 3, 2)


def test_caps_count_repeats(spark):
    df = references(spark, {"doi": "a"}, {"doi": "a"}, {"_ord": 1, "pos": 0, "doi": "b"})
    assert refs.pool(refs.capped(df, None, 2)).count() == 1
    assert refs.pool(refs.capped(df, 1, None)).count() == 2


def test_references_from_text(spark):
    text = "Body\nReferences\nnot this\nReferences\n1. Lee, A. Deep maps of old cells. Nature 12, 3 (2020). https://doi.org/10.1000/AB.1.\n2. Kim, B. & Ray, C. D. A second long title here. Cell 2019.\n3. Lee, A. Deep maps of old cells. doi 10.1000/ab.1\nAcknowledgements\n4. no."
    got = refs.extract_references(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("pos").collect()
    assert [r["doi"] for r in got] == ["10.1000/ab.1", ""]
    assert got[0]["publish_date"] == "2020" and got[0]["title"] == "Deep maps of old cells" and got[0]["journal"] == "Nature"
    assert got[1]["title"] == "A second long title here"


def test_merge_fills_only_blanks_and_takes_the_largest_count(spark):
    base = articles(spark, {"doi": "d", "title": "own"})
    src = lambda **k: spark.createDataFrame([({"doi": "d", "title": "", "journal": "", "article_type": "", "publish_date": "", "authors": [], "institutions": [], "abstract": "", "citation_count": None} | k)], "doi string, title string, journal string, article_type string, publish_date string, authors array<string>, institutions array<string>, abstract string, citation_count int")
    row = enrich.merge_sources(base, [("openalex", src(title="t1", journal="j1", citation_count=7)), ("semantic-scholar", src(journal="j2", abstract="a", citation_count=7))]).first()
    assert (row["title"], row["journal"], row["abstract_source"], row["citation_count"], row["citation_source"]) == ("own", "j1", "semantic-scholar", 7, "semantic-scholar")


def test_rules_and_clusters(spark):
    df = articles(spark, {"title": "Aging of cells", "abstract": "cells age"}, {"title": "Other"})
    got = classify.rule_classify(df, [("Bio", ["cells"]), ("Age", ["aging"])]).orderBy("_ord").collect()
    assert [(r["domain"], r["confidence"]) for r in got] == [("Bio", 0.7), (classify.UNCLASSIFIED, 0.0)]
    assert [linkage.cluster_count(n) for n in (1, 10, 100)] == [1, 4, 8]
    vectors = spark.createDataFrame([("g", i, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]])], "label string, id int, v array<double>")
    assert [r["cluster"] for r in linkage.clusters(vectors, "label").orderBy("id").collect()] == [0, 0, 1, 1]


def test_sections_chunks_and_selection(spark):
    text = "Intro words.\nAbstract\nWe show a gap.\n2. Methods\nA cohort model. More data.\nResults\nThe effect was large.\nLimitations\nHowever it may remain uncertain."
    assert [s[0] for s in evidence.sections(text)] == ["body", "abstract", "methods", "results", "limitations"]
    assert [s[0] for s in evidence.sections("no heading")] == ["body"]
    assert evidence.packed("One two. " + "x" * 30 + ". Three.", 20) == ["One two.", "x" * 30 + ".", "Three."]
    chunks = evidence.score_chunks(evidence.chunk_documents(spark.createDataFrame([(1, text)], "id int, text string"))).withColumn("score", F.col("lexical_score"))
    picked = evidence.select_evidence(chunks, 4)
    assert {r["section"] for r in picked.collect()} == {"abstract", "methods", "results", "limitations"}
    assert evidence.coverage(chunks, picked).first()["coverage_status"] == "ok"


def test_grounding(spark):
    df = spark.createDataFrame([("a tiny  Sample", "this is a tiny sample of text"), ("a tiny sampel", "this is a tiny sample of text"), ("wholly other words", "this is a tiny sample of text")], "snippet string, text string")
    assert [r["snippet"] for r in evidence.ungrounded(df, 0.8).collect()] == ["wholly other words"]
    twice = articles(spark, {"title": "A", "doi": "1"}, {"title": "B", "doi": "1"}, {"title": "a!", "doi": "2"}, {"title": "B", "doi": "3"}).select("_ord", "title", "doi")
    assert [r["_ord"] for r in evidence.greedy_distinct(twice).orderBy("_ord").collect()] == [0, 3]


def test_manifest_round_trip(spark, tmp_path):
    df = articles(spark, {"title": "Über", "authors": ["A"], "citation_count": 0}, {"title": "b"})
    sinks.write_manifest(df, str(tmp_path / "m"))
    back = records.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(r["title"] for r in back.collect()) == ["b", "Über"]
    (tmp_path / "a.json").write_text(json.dumps([{"title": "x", "odd": 1, "references": [{"title": "r"}]}, {"title": "y"}]))
    rows = records.read_manifest(spark, str(tmp_path / "a.json")).orderBy("_ord").collect()
    assert [(r["title"], r["subdomain"], r["citation_count"]) for r in rows] == [("x", "Other", None), ("y", "Other", None)]
    assert rows[0]["references"][0]["source_article_count"] == 1


def test_api_records(spark):
    work = {"title": "T", "doi": "https://doi.org/10.1/x", "publication_date": "2020-01-02", "cited_by_count": 4, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "topics": [{"display_name": "t", "field": {"display_name": "f"}, "subfield": {"display_name": "f"}, "score": 0.5}], "authorships": [{"author": {"display_name": "A"}, "institutions": [{"display_name": "I"}]}]}
    row = records.openalex_articles(spark.createDataFrame([(json.dumps(work),)], "j string").select(F.from_json("j", records.OPENALEX).alias("w")).select("w.*")).first()
    assert (row["doi"], row["abstract"], row["authors"], row["institutions"], row["authoritative_topics"][0]["label"]) == ("10.1/x", "a b a", ["A"], ["I"], "f > t")
    item = {"title": ["C"], "DOI": "10.2/y", "container-title": ["J"], "published-print": {"date-parts": [[2021, 3]]}, "author": [{"given": "A", "family": "B", "affiliation": [{"name": "U"}]}], "abstract": "<p>q</p>", "link": [{"URL": "u.pdf", "content-type": "application/pdf"}]}
    row = records.crossref_articles(spark.createDataFrame([(json.dumps(item),)], "j string").select(F.from_json("j", records.CROSSREF).alias("w")).select("w.*")).first()
    assert (row["publish_date"], row["authors"], row["institutions"], row["abstract"], row["pdf_url"]) == ("2021/3", ["A B"], ["U"], "q", "u.pdf")


def test_pages(spark):
    page = "<head><title>T</title><meta name='citation_author' content='A'><meta name='citation_author' content='B'><meta name='citation_doi' content='doi:10.1/z'></head><script>x</script><p>Hi&amp;bye</p><a href='/a/1?x=1'>one</a><a href='/a/1.pdf'>pdf</a><a href='/l?page=2'>Next page</a>"
    assert pages.parse_meta(page)[:2] == ("T", "10.1/z") and pages.parse_meta(page)[6] == ["A", "B"]
    assert value(spark, pages.visible_text(F.col("h")), h=page) == "T Hi&bye one pdf Next page"
    assert value(spark, pages.article_links(F.col("h"), "/a/"), h=page) == ["/a/1"]
    assert value(spark, pages.next_link(F.col("h")), h=page) == "/l?page=2"


def test_journals():
    found = records.parse_journals(["layered:My J=1234-5678", "nat", "Other=slug"], {"nat": records.Journal("nat", "N")})
    assert [(j.provider, j.issn, j.slug) for j in found] == [("layered", "1234-5678", ""), ("layered", "", ""), ("crawler", "", "slug")]


def test_ris_and_reports(spark, tmp_path):
    df = articles(spark, {"title": "A\nb", "authors": ["X"], "publish_date": "2020-01"})
    assert df.select(sinks.ris_record()).first()[0] == "TY  - JOUR\nTI  - A b\nAU  - X\nPY  - 2020\nER  -\n"
    sinks.write_report(df, str(tmp_path / "r"), ["title", "authors", "citation_count"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() >= 1


def test_monitor(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("a", 3, "y", None)], "k string, t int, s string, n int")
    assert tuple(monitor.latest_state(df, "k", ["t"], ["s", "n"]).first())[1:] == ("y", 5)
    assert [r["t"] for r in monitor.last_events(df, "k", ["t"], 2).orderBy("place").collect()] == [3, 2]
