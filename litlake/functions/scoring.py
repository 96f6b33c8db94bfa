"""Scores of papers and references as column expressions; the year is a parameter, never the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import extract_year, normalize

#: Journals by name, their tier and score, in the order in which they are tried.
TIERS = (
    ("nature", "top_general", 1.0),
    ("science", "top_general", 1.0),
    ("cell", "top_general", 1.0),
    ("new england journal of medicine", "top_medical", 1.0),
    ("the lancet", "top_medical", 1.0),
    ("jama", "top_medical", 0.95),
    ("nature medicine", "top_field", 0.92),
    ("nature biotechnology", "top_field", 0.92),
    ("nature aging", "top_field", 0.86),
    ("nature neuroscience", "top_field", 0.88),
    ("nature genetics", "top_field", 0.88),
    ("pnas", "high_impact", 0.82),
    ("proceedings of the national academy of sciences", "high_impact", 0.82),
    ("elife", "high_impact", 0.76),
    ("aging cell", "field_journal", 0.72),
    ("geroscience", "field_journal", 0.68),
    ("ieee transactions on pattern analysis and machine intelligence", "top_field", 0.9),
    ("international journal of computer vision", "top_field", 0.82),
)
UNMAPPED = ("unmapped", 0.45)


def journal_tier(journal: Column, tiers: Sequence[tuple[str, str, float]] = TIERS, default: tuple[str, float] = UNMAPPED) -> tuple[Column, Column]:
    """(tier, score): the exact name, else the first entry where either name contains the other, else the default.

    The map is small and ordered, so it is an expression: no join, no shuffle."""
    key = normalize(journal)
    entry = lambda name, t, s: F.struct(F.lit(name).alias("name"), F.lit(t).alias("tier"), F.lit(float(s)).alias("score"))
    entries = F.array(*[entry(*x) for x in tiers])  # folded to a constant
    exact = F.filter(entries, lambda x: x["name"] == key)
    near = F.filter(entries, lambda x: (key != "") & (F.contains(key, x["name"]) | F.contains(x["name"], key)))
    hit = F.coalesce(F.get(exact, F.lit(0)), F.get(near, F.lit(0)), entry("", *default))
    return hit["tier"], hit["score"]


def citation_score(citations: Column, most: Column) -> Column:
    c = F.coalesce(citations, F.lit(0))
    return F.when((c > 0) & (most > 0), F.least(F.lit(1.0), F.log1p(c) / F.log1p(most))).otherwise(F.lit(0.0))


def recency_score(date: Column, as_of_year: int) -> Column:
    year = extract_year(date).try_cast("int")
    age = F.least(F.greatest(F.lit(as_of_year) - year, F.lit(0)), F.lit(20))
    return F.coalesce(F.greatest(F.lit(0.2), 1.0 - age / 20), F.lit(0.45))


def is_review(kind: Column, title: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(title, F.lit("")))).rlike("review|survey")


def is_research(kind: Column, title: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k == "", ~is_review(kind, title)).otherwise(~k.rlike("review|editorial|comment|news|perspective"))


def _share(flags: list[Column]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(f, F.lit(False)).cast("int")
    return total / len(flags)


def completeness() -> Column:
    """Share of nine fields that an article has."""
    c = F.col
    flags = [c("title") != "", c("doi") != "", c("journal") != "", c("publish_date") != "", F.size("authors") > 0, F.size("institutions") > 0, c("abstract") != "", c("citation_count").isNotNull(), c("subdomain") != ""]
    return F.round(_share(flags), 3)


def reference_completeness() -> Column:
    c = F.col
    return _share([c("title") != "", c("doi") != "", c("journal") != "", c("publish_date") != "", F.size("authors") > 0, c("abstract") != "", c("citation_count").isNotNull()])


def paper_value(most: Column, as_of_year: int, tiers: Sequence[tuple[str, str, float]] = TIERS) -> tuple[Column, Column, Column]:
    """(value, reason, tier) of an article, against the largest citation count ``most``."""
    tier, tier_score = journal_tier(F.col("journal"), tiers)
    parts = citation_score(F.col("citation_count"), most), recency_score(F.col("publish_date"), as_of_year), F.when(is_review(F.col("article_type"), F.col("title")), 0.75).otherwise(0.45)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("classification_confidence", F.lit(0.0))))
    value = 0.30 * parts[0] + 0.20 * tier_score + 0.18 * parts[1] + 0.12 * parts[2] + 0.10 * confidence + 0.10 * completeness()
    reason = F.format_string("citations=%.3f; journal=%s:%.3f; recency=%.3f; review_entry=%.3f; metadata=%.3f", parts[0], tier, tier_score, parts[1], parts[2], completeness())
    return F.round(F.least(F.lit(1.0), value), 3), reason, tier


def reference_value(most: Column, as_of_year: int, tiers: Sequence[tuple[str, str, float]] = TIERS) -> tuple[Column, Column, Column]:
    """(value, tier, tier score) of a reference with relevance_score and source_article_count."""
    tier, tier_score = journal_tier(F.col("journal"), tiers)
    value = (
        0.35 * F.coalesce("relevance_score", F.lit(0.0))
        + 0.20 * citation_score(F.col("citation_count"), most)
        + 0.15 * tier_score
        + 0.10 * F.least(F.lit(1.0), F.col("source_article_count") / 5)
        + 0.10 * recency_score(F.col("publish_date"), as_of_year)
        + 0.10 * reference_completeness()
    )
    return F.round(F.least(F.lit(1.0), value), 3), tier, F.round(tier_score, 3)


def recommendation_type(as_of_year: int) -> Column:
    year = extract_year(F.col("publish_date")).try_cast("int")
    return F.when(is_review(F.col("article_type"), F.col("title")), "review_entry").when(year >= as_of_year - 3, "recent_high_potential").when(F.coalesce("citation_count", F.lit(0)) >= 100, "classic").otherwise("important")


def rule_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.72), 0.58 + 0.02 * F.least(score, F.lit(7))), 3)


def downgraded(confidence: Column, reliability: Column) -> Column:
    """Low reliability makes any confidence low; medium caps high."""
    return F.when(reliability == "low", "low").when((reliability == "medium") & (confidence == "high"), "medium").otherwise(confidence)
