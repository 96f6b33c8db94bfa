"""Summaries of stages and collections, and the rows that packages and rankings hand on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import TIERS, recommendation_type
from ..functions.text import extract_year, reference_key
from ..tables import cut
from . import ranking, references as refs_, stats
from .filters import ris_exportable

#: The columns of a paper as it is handed to a reader.
PAYLOAD = (
    "paper_id", "title", "doi", "journal", "year", "publish_date", "authors", "institutions", "abstract", "article_type", "domain", "classification_source", "classification_taxonomy",
    "classification_source_label", "authoritative_topics", "citation_count", "research_value_score", "value_reason", "journal_tier",
)


def has_pdf() -> Column:
    return (F.col("pdf_status") == "complete") & (F.coalesce("local_pdf_path", F.lit("")) != "")


def domain_or_other() -> Column:
    return F.coalesce(F.nullif(F.col("subdomain"), F.lit("")), F.lit("Other"))


def corpus_lists(articles: DataFrame, top: int) -> DataFrame:
    """The lists of the corpus summary as (entry, name, paper_count, citation_count): subdomains with all beyond the first ``top``
    as one, the first authors, institutions and journals, and all sources of classification."""
    fold = stats.fold_tail(stats.group_counts(articles, domain_or_other(), "name"), "name", top, ["paper_count", "citation_count"])
    kinds = (("top_authors_by_citations", F.col("authors"), True), ("top_institutions_by_citations", F.col("institutions"), True), ("top_journals_by_citations", F.col("journal"), False))
    parts = [("top_subdomains", fold), ("classification_sources", stats.group_counts(articles, stats.source_or_unknown(), "name"))]
    parts += [(entry, stats.ranked(stats.group_counts(articles, key, "name", many), "name", top)) for entry, key, many in kinds]
    out = None
    for entry, rows in parts:
        rows = rows.select(F.lit(entry).alias("entry"), "name", "paper_count", "citation_count")
        out = rows if out is None else out.unionByName(rows)
    return out


def citation_rankings(articles: DataFrame) -> DataFrame:
    """Citations by author and by institution as (kind, name, citation_count); one named twice in a paper gets them twice."""
    parts = [articles.select(F.lit(kind).alias("kind"), F.explode(c).alias("name"), stats.cited().alias("c")) for kind, c in (("author", "authors"), ("institution", "institutions"))]
    return parts[0].unionByName(parts[1]).groupBy("kind", "name").agg(F.sum("c").cast("long").alias("citation_count"))


def pool_summary(references: DataFrame, threshold: float) -> DataFrame:
    """One row over a scored pool; the tiers as "name=count", by name."""
    tiers = references.groupBy(F.coalesce(F.nullif(F.col("journal_tier"), F.lit("")), F.lit("unmapped")).alias("t")).agg(
        F.count("*").alias("n"), F.count_if(F.col("relevance_score") >= threshold).alias("r"), F.count_if(has_pdf()).alias("d")
    )  # a row for each tier
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat_ws("=", x["t"], x["n"].cast("string"))), "; ")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return tiers.agg(total("n").alias("total_references"), total("r").alias("relevant_references"), total("d").alias("downloaded_references"), F.lit(float(threshold)).alias("relevance_threshold"), shown.alias("journal_tiers"))


def download_summary(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: candidates, eligible ones, selected ones and how many of these are complete."""
    left = ranked.agg(F.count("*").alias("total_candidates"), F.count_if("eligible").alias("eligible_candidates"))
    right = selected.agg(F.count("*").alias("selected_for_download"), F.count_if(has_pdf()).alias("completed_pdfs"))
    return left.crossJoin(F.broadcast(right))  # single rows


def ris_summary(articles: DataFrame) -> DataFrame:
    n = F.count_if(ris_exportable())
    return articles.agg(F.count("*").alias("total_records"), n.alias("exported_records"), (F.count("*") - n).alias("skipped_records"))


def ris_reference_summary(articles: DataFrame, references: DataFrame, relevant: DataFrame, most: int | None = None) -> DataFrame:
    """One row: papers, references, those exported (of ``relevant`` the first ``most``), and the rest."""
    count = lambda rows, name: F.broadcast(rows.agg(F.count("*").alias(name)))
    out = count(articles, "total_source_articles").crossJoin(count(references, "total_references")).crossJoin(count(relevant, "n"))
    exported = F.col("n") if most is None else F.least("n", F.lit(most))
    return out.select("total_source_articles", "total_references", exported.alias("exported_records"), (F.col("total_references") - exported).alias("skipped_records"))


def percent_to_threshold(percent: float | None, default: float = 0.12) -> float:
    """A relevance in percent as a share; outside 0 to 100 is an error."""
    if percent is None:
        return default
    if not 0 <= percent <= 100:
        raise ValueError("a percentage lies between 0 and 100")
    return percent / 100


def citing_titles(references: DataFrame, most: int = 5) -> DataFrame:
    """(ref_key, cited_by_source_papers): the first titles that cite a reference, each once, joined by bars. Titles are made
    distinct and ranked before they are gathered, so a reference of very many papers is no large group."""
    key = reference_key(F.col("doi"), F.col("title"))
    each = references.where((key != "") & (F.coalesce("source_title", F.lit("")) != "")).groupBy(key.alias("ref_key"), "source_title").agg(F.min(F.struct("_ord", "pos")).alias("o"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("ref_key").orderBy("o"))).where(F.col("n") <= most)
    titles = F.transform(F.array_sort(F.collect_list(F.struct("n", "source_title"))), lambda x: x["source_title"])
    return first.groupBy("ref_key").agg(F.array_join(titles, " | ").alias("cited_by_source_papers"))


def research_profile(articles: DataFrame, insights: DataFrame, as_of_year: int, top: int, tiers: Sequence[tuple[str, str, float]] = TIERS) -> dict[str, DataFrame]:
    """The parts of a profile by name. The typed lists are taken from the recommendations after their cut to ``top``."""
    best = ranking.recommendations(articles, as_of_year, top, tiers)
    profiles = stats.topic_profiles(articles)
    kind = {"classic_papers": "classic", "recent_high_potential_papers": "recent_high_potential", "review_entry_points": "review_entry"}
    return {
        "overview": stats.corpus_summary(articles), "topic_profiles": ordered_profiles(profiles).limit(top), "year_trend": stats.group_counts(articles, stats.year_or_unknown(), "year"),
        "growing_topics": stats.growing(profiles).limit(top), "core_references": insights.limit(top),
    } | {name: best.where(F.col("recommendation_type") == k) for name, k in kind.items()}


def statistics_bundle(articles: DataFrame, references: DataFrame, as_of_year: int, top: int = 20, tiers: Sequence[tuple[str, str, float]] = TIERS) -> dict[str, DataFrame]:
    """Every table of the statistics by name, ordered: ``summary`` and the ``profile/...`` parts of one row or few, the others
    reports. Articles are written once, as fifteen tables are made from them."""
    rows = cut(articles, "articles")
    insights = refs_.insights(references, top)
    key = reference_key(F.col("doi"), F.col("title")).alias("ref_key")
    counts = lambda column, name, many=False: stats.group_counts(rows, column, name, many)
    by_name = lambda frame, name: frame.orderBy(F.col(name) == "Unknown", name)
    best = rows.orderBy(F.desc(stats.cited()), F.lower("title"), "_ord").limit(top)
    first = ("title", "doi", "journal")
    year = extract_year(F.col("publish_date")).alias("year")
    advice = ranking.recommendations(rows, as_of_year, top, tiers)
    profile = research_profile(rows, insights, as_of_year, top, tiers)
    return {
        "summary": stats.corpus_summary(rows), "subdomain_stats": stats.ranked(stats.subdomain_stats(rows), "subdomain"), "classification_source_stats": stats.ranked(counts(stats.source_or_unknown(), "classification_source"), "classification_source"),
        "topic_profiles": ordered_profiles(stats.topic_profiles(rows)), "year_trend": by_name(counts(stats.year_or_unknown(), "year"), "year"), "author_stats": stats.ranked(counts(F.col("authors"), "author", True), "author", top), "institution_stats": stats.ranked(counts(F.col("institutions"), "institution", True), "institution", top),
        "team_stats": stats.ranked(counts(stats.team_label(), "team"), "team", top), "top_papers": best.select(*first, year, "subdomain", "article_type", stats.cited().alias("citation_count")),
        "paper_recommendations": advice.orderBy("rank").select("rank", "recommendation_type", *first, "journal_tier", year, "subdomain", "article_type", stats.cited().alias("citation_count"), "research_value_score", F.col("value_reason").alias("reason")),
        "article_type_stats": stats.ranked(counts(F.col("article_type"), "article_type"), "article_type"), "journal_stats": stats.ranked(counts(F.col("journal"), "journal"), "journal", top), "subdomain_year_trend": stats.subdomain_year(rows).orderBy("year", "subdomain"),
        "citation_bucket_stats": counts(stats.citation_bucket(), "citation_bucket").orderBy("citation_bucket"), "collaboration_stats": stats.ranked(counts(stats.collaboration_type(), "collaboration_type"), "collaboration_type"),
        "reference_insights": insights.withColumn("year", extract_year(F.col("publish_date"))).select(*first, "year", "citation_count", "source_article_count", "relevance_score", "value_score", key).join(citing_titles(references), "ref_key", "left").orderBy(F.desc("value_score"), F.desc("relevance_score"), F.desc("source_article_count"), F.desc("citation_count"), F.lower("title"), "ref_key").drop("ref_key"),
    } | {f"profile/{name}": frame for name, frame in profile.items()}


def ordered_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("paper_count"), F.desc("citation_count"), F.lower("subdomain"), "subdomain")


def ordered_pool(pool: DataFrame) -> DataFrame:
    """A scored pool by value, relevance, title."""
    return pool.orderBy(F.desc("value_score"), F.desc("relevance_score"), F.lower("title"), "ref_key")


def ranking_rows(ranked: DataFrame, selected: DataFrame, as_of_year: int) -> DataFrame:
    """All columns of the ranking report; ``selected`` holds the _ord of the papers chosen for download."""
    c = F.col
    rows = ranked.join(selected.select("_ord", F.lit(True).alias("_chosen")), "_ord", "left")
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return rows.select(
        "rank", F.coalesce("_chosen", F.lit(False)).alias("selected_for_download"), "eligible", "eligibility_reason", recommendation_type(as_of_year).alias("recommendation_type"), "title", "doi", "journal", "journal_tier",
        extract_year(c("publish_date")).alias("year"), domain_or_other().alias("subdomain"), F.coalesce(F.nullif(c("article_type"), F.lit("")), F.lit("Unknown")).alias("article_type"), stats.cited().alias("citation_count"),
        text("citation_source"), "research_value_score", c("value_reason").alias("reason"), text("pdf_url"), text("local_pdf_path"), text("download_status"), text("pdf_status"), text("error"),
    )


def paper_entries(papers: DataFrame) -> DataFrame:
    """All columns of a packaged paper, with its id and domain."""
    c = F.col
    return papers.select(
        "paper_id", "title", "doi", "journal", extract_year(c("publish_date")).alias("year"), "publish_date", "authors", "institutions", "abstract", "article_type", domain_or_other().alias("domain"),
        "classification_source", "classification_taxonomy", "classification_source_label", "authoritative_topics", stats.cited().alias("citation_count"), "citation_source", F.coalesce("local_pdf_path", F.lit("")).alias("local_pdf_path"), "pdf_status",
        "research_value_score", "value_reason", "journal_tier",
    )


def payload(entries: DataFrame) -> DataFrame:
    """(domain, paper_id, payload): a packaged paper as JSON for a reader, without its paths."""
    return entries.select("domain", "paper_id", F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"}).alias("payload"))


def top_downloaded(articles: DataFrame, as_of_year: int, most: int, per_domain: int = 0, tiers: Sequence[tuple[str, str, float]] = TIERS) -> DataFrame:
    """Papers with a complete PDF, valued among themselves: the best ``most``; or the best ``per_domain`` of each subdomain, the
    largest first, of these the first ``most`` (all if 0). Columns domain_rank and place order them."""
    rows = ranking.valued(articles.where(has_pdf()).withColumn("subdomain", domain_or_other()), as_of_year, tiers)
    if per_domain <= 0:
        best = rows.orderBy(*ranking.best_first()).limit(most)
        return best.withColumns({"domain_rank": F.lit(1), "place": F.row_number().over(Window.orderBy(*ranking.best_first()))})
    sizes = rows.groupBy("subdomain").agg(F.count("*").alias("_n"), F.sum(stats.cited()).alias("_c"))
    sizes = sizes.withColumn("domain_rank", F.row_number().over(Window.orderBy(F.desc("_n"), F.desc("_c"), "subdomain"))).drop("_n", "_c")  # a row for each domain
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("subdomain").orderBy(*ranking.best_first()))).where(F.col("place") <= per_domain)
    out = rows.join(sizes, "subdomain")
    return out.orderBy("domain_rank", "place").limit(most) if most > 0 else out


def packages(papers: DataFrame) -> DataFrame:
    """(domain_id, domain_name, selected_paper_count, citation_count) of selected papers, ids by the order of names."""
    rows = papers.groupBy(domain_or_other().alias("domain_name")).agg(F.count("*").alias("selected_paper_count"), F.sum(stats.cited()).cast("long").alias("citation_count"))
    return rows.withColumn("domain_id", F.format_string("domain_%03d", F.row_number().over(Window.orderBy("domain_name"))))  # a row for each domain
