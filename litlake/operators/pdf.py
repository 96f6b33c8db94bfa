"""Files of papers: whether one is complete, what it is called, and what is to be done with a paper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..functions.text import extract_year

#: What marks a page behind a paywall, the least size of a paper in bytes, and how much of it is looked at.
PAYWALL = ("subscribe", "purchase", "log in", "login", "institutional access", "access this article")
LEAST_BYTES, SAMPLE = 200_000, 256 * 1024
#: Lengths of a file name's parts.
NAME, PREFIX, SUFFIX, LEAST_TITLE = 180, 40, 80, 20


def state(content: Column, length: Column, paywall: Sequence[str] = PAYWALL, least: int = LEAST_BYTES) -> Column:
    """Of a file (its bytes, or the first of them, and its length) "complete" or the first reason against it."""
    text = F.lower(F.decode(F.substring(content, 6, SAMPLE), "ISO-8859-1"))
    walled = F.exists(F.array(*[F.lit(p) for p in paywall]), lambda p: F.contains(text, p))
    return (
        F.when(content.isNull(), "missing_file")
        .when(length < least, "too_small")
        .when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "not_pdf")
        .when(walled, "paywalled_or_incomplete")
        .when(~(F.contains(text, F.lit("abstract")) | F.contains(text, F.lit("references"))), "missing_paper_markers")
        .otherwise("complete")
    )


def safe_name(x: Column, most: Column | int) -> Column:
    """A part of a file name: characters that some systems forbid become underscores, white space one space."""
    v = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "_")
    v = F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(v == "", "paper").otherwise(v), F.lit(1), most if isinstance(most, Column) else F.lit(most))


def _or(x: Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")), F.lit(other))


def file_name() -> Column:
    """（year，journal）title（author，institution）.pdf with the title cut so that all fits."""
    before_comma = lambda x: F.get(F.split(x, ","), F.lit(0))
    initials = F.array_join(F.transform(F.regexp_extract_all(F.coalesce("journal", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.upper(F.substring(w, 1, 1))), "")
    journal = F.when(F.lower("journal") == "nature aging", "NA").otherwise(_or(initials, "未知期刊"))
    bracketed = lambda a, b: F.concat(F.lit("（"), a, F.lit("，"), b, F.lit("）"))
    head = safe_name(bracketed(_or(extract_year(F.col("publish_date")), "未知年份"), journal), PREFIX)
    tail = safe_name(bracketed(_or(before_comma(F.get("authors", F.lit(0))), "未知作者"), _or(before_comma(F.get("institutions", F.lit(0))), "未知机构")), SUFFIX)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("doi"), F.lit("")), F.lit("paper"))
    return F.concat(head, safe_name(title, F.greatest(F.lit(LEAST_TITLE), NAME - F.length(head) - F.length(tail))), tail, F.lit(".pdf"))


def gate(metadata_only: bool = False, only_candidates: bool = False, dry_run: bool = False) -> Column:
    """The download status of a paper that passed the filter; null: it is to be downloaded."""
    if metadata_only:
        return F.lit("metadata_only")
    out = F.lit("dry_run") if dry_run else F.lit(None).cast("string")
    return F.when(F.coalesce("pdf_url", F.lit("")) == "", "skipped").otherwise(out) if only_candidates else out
