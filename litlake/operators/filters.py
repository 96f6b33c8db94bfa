"""Predicates over articles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.text import extract_year, normalize

#: Other spellings that a keyword also matches.
ALIASES = {"llm": ("large language model", "large language models"), "casual discovery": ("causal discovery",)}
#: What marks a text as biomedical.
BIOMEDICAL = ("medicine", "medical", "clinical", "biomedical", "biology", "neuroscience", "brain", "neuro", "disease", "patient", "therapy", "diagnosis", "health")


def _clean(text: str) -> str:
    return " ".join(text.lower().split())


@dataclass
class ArticleFilter:
    """All keywords, any type, at least so many citations, a range of years (or one), any author, any institution."""

    keywords: Sequence[str] = field(default_factory=tuple)
    article_types: Sequence[str] = field(default_factory=tuple)
    min_citations: int | None = None
    year: int | None = None
    from_year: int | None = None
    to_year: int | None = None
    authors: Sequence[str] = field(default_factory=tuple)
    institutions: Sequence[str] = field(default_factory=tuple)

    def column(self) -> Column:
        """One conjunction, so that the optimizer pushes down what it can; without criteria true."""
        tests: list[Column] = []
        if self.keywords:
            text = normalize(F.concat_ws(" ", "title", "abstract", "journal", "article_type"))
            tests += [reduce(Column.__or__, [F.contains(text, F.lit(k)) for k in (_clean(w), *ALIASES.get(_clean(w), ()))]) for w in self.keywords]
        if self.article_types:
            tests.append(reduce(Column.__or__, [F.contains(normalize(F.col("article_type")), F.lit(_clean(t))) for t in self.article_types]))
        if self.min_citations is not None:
            tests.append(F.coalesce("citation_count", F.lit(0)) >= self.min_citations)
        low, high = (self.year, self.year) if self.year is not None else (self.from_year, self.to_year)
        year = extract_year(F.col("publish_date")).try_cast("int")
        tests += [F.coalesce(year >= low, F.lit(False))] * (low is not None) + [F.coalesce(year <= high, F.lit(False))] * (high is not None)
        for name, wanted in (("authors", self.authors), ("institutions", self.institutions)):
            if wanted:
                tests.append(F.exists(name, lambda v: reduce(Column.__or__, [F.contains(normalize(v), F.lit(_clean(w))) for w in wanted])))
        return reduce(Column.__and__, tests) if tests else F.lit(True)


def looks_biomedical(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(BIOMEDICAL))


def looks_like_pdf_url(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.endswith(u, F.lit(".pdf")) | F.contains(u, F.lit("/pdf")) | F.contains(u, F.lit("pdf=")) | F.contains(u, F.lit("type=printable"))


def missing_fields() -> Column:
    """Names of the metadata an article lacks."""
    c = F.col
    tests = [(n, c(n) == "") for n in ("doi", "journal", "article_type", "publish_date", "abstract")] + [(n, F.size(n) == 0) for n in ("authors", "institutions")]
    tests.append(("citation_count", c("citation_count").isNull()))
    return F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())


def sufficient_metadata() -> Column:
    return F.size(missing_fields()) == 0


def can_help(supported: Sequence[str]) -> Column:
    """A source helps if it can be asked (by DOI or title) and knows a field that is missing."""
    return ((F.col("doi") != "") | (F.col("title") != "")) & F.arrays_overlap(missing_fields(), F.array(*[F.lit(s) for s in supported]))


def download_eligibility(value: Column, least: float | None = None, need_doi: bool = True, skip_existing: bool = True) -> Column:
    """The first reason against a download, else "eligible"."""
    reason = F.lit("eligible")
    if skip_existing:
        reason = F.when((F.col("pdf_status") == "complete") & (F.col("local_pdf_path") != ""), "already_complete").otherwise(reason)
    if least is not None:
        reason = F.when(value < least, "below_min_value_score").otherwise(reason)
    return F.when(F.col("doi") == "", "missing_doi").otherwise(reason) if need_doi else reason


def ris_exportable(statuses: Sequence[str] = ("downloaded", "skipped_existing", "skipped_existing_renamed")) -> Column:
    c = F.col
    return (c("title") != "") & (c("doi") != "") & (c("local_pdf_path") != "") & (c("pdf_status") == "complete") & c("download_status").isin(*statuses)
