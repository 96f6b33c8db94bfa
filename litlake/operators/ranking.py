"""Rankings of papers, overall and within subdomains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import TIERS, paper_value, recommendation_type
from ..tables import cut, once
from .filters import download_eligibility
from .stats import cited


def with_most_cited(articles: DataFrame, by: str | None = None) -> DataFrame:
    """The largest citation count, overall (a single row, broadcast) or of each ``by``, as ``_most``. The articles are written
    once, and a ``by`` of very many is summed up before it is joined, so that no task holds it."""
    articles = once(articles, "articles")
    if by:
        most = articles.groupBy(F.col(by).alias("_by")).agg(F.max(cited()).alias("_most"))
        return articles.join(most, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return articles.crossJoin(F.broadcast(articles.agg(F.coalesce(F.max(cited()), F.lit(0)).alias("_most"))))


def valued(articles: DataFrame, as_of_year: int, tiers: Sequence[tuple[str, str, float]] = TIERS, by: str | None = None) -> DataFrame:
    """Articles with research_value_score, value_reason and journal_tier."""
    value, reason, tier = paper_value(F.col("_most"), as_of_year, tiers)
    rows = with_most_cited(articles, by)
    return rows.withColumns({"research_value_score": value, "value_reason": reason, "journal_tier": tier}).drop("_most")


def best_first() -> list[Column]:
    return [F.desc("research_value_score"), F.desc(cited()), F.lower("title"), F.col("_ord")]


def recommendations(articles: DataFrame, as_of_year: int, most: int = 20, tiers: Sequence[tuple[str, str, float]] = TIERS) -> DataFrame:
    """The best papers with rank and kind of recommendation; only the first ``most`` are ever sorted in one place."""
    top = valued(articles, as_of_year, tiers).withColumn("recommendation_type", recommendation_type(as_of_year)).orderBy(*best_first()).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row numbers of the whole table in an order, without one task that holds it: rows are range-partitioned and sorted,
    and each partition's numbers start after the counts of those before it. The numbered partitions are written once, as
    another run of the same plan may deal its rows otherwise."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    # within a partition the id grows by one from row to row
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # a row for each partition
    out = dealt.join(F.broadcast(sizes), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")).drop("_part", "_at", "_n", "_first", "_before")


def rank_for_download(articles: DataFrame, as_of_year: int, least: float | None = None, need_doi: bool = True, tiers: Sequence[tuple[str, str, float]] = TIERS) -> DataFrame:
    """Every paper with its rank and whether, or why not, it is eligible."""
    rows = global_rank(valued(articles, as_of_year, tiers), best_first())
    reason = download_eligibility(F.col("research_value_score"), least, need_doi)
    return rows.withColumn("eligibility_reason", reason).withColumn("eligible", F.col("eligibility_reason") == "eligible")


def select_papers(ranked: DataFrame, top: int, per_domain: int = 0) -> DataFrame:
    """Of the eligible papers the first ``top``; or, with ``per_domain``, as many of each of the first ``top`` subdomains (all if
    0), ordered by size, citations, name."""
    eligible = ranked.where("eligible")
    if per_domain <= 0:
        return eligible.orderBy("rank").limit(top)
    domains = eligible.groupBy("subdomain").agg(F.count("*").alias("_n"), F.sum(cited()).alias("_c"))
    domains = domains.withColumn("domain_rank", F.row_number().over(Window.orderBy(F.desc("_n"), F.desc("_c"), "subdomain"))).drop("_n", "_c")
    if top > 0:
        domains = domains.where(F.col("domain_rank") <= top)
    within = eligible.withColumn("place", F.row_number().over(Window.partitionBy("subdomain").orderBy("rank"))).where(F.col("place") <= per_domain)
    return within.join(domains, "subdomain")


def select_domains(articles: DataFrame, most: int) -> DataFrame:
    rows = articles.groupBy("subdomain").agg(F.count("*").alias("paper_count"), F.sum(cited()).cast("long").alias("citation_count"))
    return rows.where(~F.startswith("subdomain", F.lit("其他领域"))).orderBy(F.desc("paper_count"), F.desc("citation_count"), "subdomain").limit(most)


def domain_papers(articles: DataFrame, domains: DataFrame, as_of_year: int, most: int, tiers: Sequence[tuple[str, str, float]] = TIERS) -> DataFrame:
    """The best papers of the given domains, valued against their own domain's most cited, with ids paper_001, ..."""
    rows = valued(articles, as_of_year, tiers, by="subdomain").join(F.broadcast(domains.select("subdomain")), "subdomain", "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("subdomain").orderBy(*best_first()))).where(F.col("place") <= most)
    return rows.withColumn("paper_id", F.format_string("paper_%03d", "place"))
