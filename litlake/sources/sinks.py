"""Where results go: manifests, reports, RIS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ARTICLE
from ..tables import cut, put_text


def write_manifest(articles: DataFrame, path: str) -> None:
    """JSON lines in the order of ``_ord``, which is written with each record."""
    articles.select(*[f.name for f in ARTICLE.fields], "_ord").write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with a header that begins with a byte order mark, for spreadsheets; what is missing is empty; arrays are joined by
    semicolons. Each part file is a report of its own."""
    kinds = dict(rows.dtypes)
    mark = "\ufeff"
    names = [mark * (i == 0) + c for i, c in enumerate(fields)]
    cols = [F.coalesce(F.array_join(c, "; ") if kinds[c].startswith("array<string") else F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(fields, names)]
    rows.select(*cols).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json_row(row: DataFrame, path: str) -> None:
    """A summary of one row as a JSON object; nulls stay."""
    row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_ranking(ranked: DataFrame, summary: DataFrame, path: str) -> None:
    """All columns of the ranking as CSV, in its order, and the stage's summary."""
    write_report(ranked.orderBy("rank"), f"{path}/ranking", ranked.columns)
    write_json_row(summary, f"{path}/summary")


def write_references(pool: DataFrame, summary: DataFrame, path: str, most: int = 50) -> None:
    """A scored pool, ordered, as JSON lines and CSV; its first ``most``; and its summary. The pool is made once; its order is kept
    as a number, as a table that is read again has none."""
    texts = [c for c, kind in pool.dtypes if not kind.startswith(("map", "struct", "array<struct"))]
    kept = cut(pool.withColumn("_place", F.monotonically_increasing_id()), "pool").orderBy("_place")
    kept.drop("_place").write.mode("overwrite").json(f"{path}/manifest")
    write_report(kept, f"{path}/candidates", texts)
    write_report(kept.limit(most), f"{path}/top", texts)
    write_json_row(summary, f"{path}/summary")


def write_basic_stats(rankings: DataFrame, citations: DataFrame, path: str) -> None:
    """Histograms (kind, name, count) and citation rankings (kind, name, citation_count), a JSON line for each, best first."""
    counts = rankings.select(F.concat("kind", F.lit("_counts")).alias("entry"), "name", F.col("count").cast("long").alias("value"))
    ranked = citations.select(F.concat("kind", F.lit("_citation_ranking")).alias("entry"), "name", F.col("citation_count").alias("value"))
    counts.unionByName(ranked).orderBy("entry", F.desc("value"), "name").write.mode("overwrite").json(path)


def write_packages(papers: DataFrame, path: str) -> None:
    """A folder for every subdomain."""
    papers.write.mode("overwrite").partitionBy("subdomain").json(path)


def write_bundle(frames: dict[str, DataFrame], path: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def write_statistics(bundle: dict[str, DataFrame], path: str) -> None:
    """``summaries.statistics_bundle``: the summary as a JSON object, profile parts as JSON lines, the others as CSV."""
    for name, frame in bundle.items():
        if name == "summary":
            write_json_row(frame, f"{path}/{name}")
        elif name.startswith("profile/"):
            frame.write.mode("overwrite").json(f"{path}/{name}")
        else:
            write_report(frame, f"{path}/{name}", frame.columns)


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def ris_record() -> Column:
    """An article or reference as a RIS record; empty fields have no line."""
    line = lambda tag, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), _clean(x)))
    c = F.col
    authors = F.transform("authors", lambda a: F.concat(F.lit("AU  - "), _clean(a)))
    rest = F.filter(F.array(line("PY", F.substring("publish_date", 1, 4)), line("DO", c("doi")), line("JF", c("journal")), line("AB", c("abstract"))), lambda x: x.isNotNull())
    return F.concat(F.array_join(F.concat(F.array(F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), _clean(c("title")))), authors, rest, F.array(F.lit("ER  -"))), "\n"), F.lit("\n"))


def write_ris(rows: DataFrame, path: str) -> None:
    rows.select(ris_record().alias("value")).write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame, columns: Sequence[str], most: int = 20) -> str:
    """The first rows of a small, ordered frame as Markdown."""
    from ..functions.text import cut_cell

    found = rows.select(*[F.coalesce(cut_cell(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]).limit(most).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(r) + " |" for r in found)])


#: Tables of a survey's report: heading, name in the statistics bundle, columns.
REPORT_TABLES = (
    ("Papers by Year", "year_trend", ("year", "paper_count", "citation_count")), ("Topics", "topic_profiles", ("subdomain", "paper_count", "citation_count", "representative_keywords", "trend")), ("Journals", "journal_stats", ("journal", "paper_count", "citation_count")),
    ("Authors", "author_stats", ("author", "paper_count", "citation_count")), ("Institutions", "institution_stats", ("institution", "paper_count", "citation_count")), ("Most Cited Papers", "top_papers", ("title", "journal", "year", "citation_count")),
    ("Core References", "reference_insights", ("title", "journal", "year", "value_score", "cited_by_source_papers")),
)


def survey_report(bundle: dict[str, DataFrame], domains: DataFrame, title: str, most: int = 10) -> str:
    """A collection's report as Markdown: the numbers of ``summaries.statistics_bundle``, its first ``most`` rows of each table,
    what to read first, and the reports (domain, report) of the first ``most`` domains by name, a level deeper. All of it is
    made of rows that are few by their ``limit``."""
    from ..operators.reports import NOTHING, recommended_reading

    row = bundle["summary"].first().asDict()
    parts = [f"# {title}", "", "## Overview", "", *(f"- {k.replace('_', ' ').capitalize()}: {v}" for k, v in row.items()), ""]
    for heading, name, columns in REPORT_TABLES:
        parts += [f"## {heading}", "", markdown_table(bundle[name], columns, most), ""]
    reading = [r["title"] for r in recommended_reading(bundle["paper_recommendations"], most).orderBy("place").collect()]
    parts += ["## Read First", "", *([f"- {t}" for t in reading] or [NOTHING]), ""]
    for r in domains.orderBy("domain").limit(most).collect():
        parts += ["\n".join(f"#{line}" if line.startswith("#") else line for line in r["report"].split("\n")), ""]
    return "\n".join(parts)


def write_survey(bundle: dict[str, DataFrame], domains: DataFrame, title: str, path: str, most: int = 10) -> None:
    put_text(domains.sparkSession, f"{path}/report.md", survey_report(bundle, domains, title, most))
