"""The two record types, as Spark schemas, and how missing fields are filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TEXT, COUNT, SCORE = T.StringType(), T.IntegerType(), T.DoubleType()
TEXTS, COUNTS = T.ArrayType(TEXT), T.MapType(TEXT, COUNT)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


EVIDENCE = T.ArrayType(_struct(source=TEXT, taxonomy=TEXT, label=TEXT, domain=TEXT, confidence=SCORE, raw=TEXT))
TOPICS = T.ArrayType(_struct(source=TEXT, taxonomy=TEXT, label=TEXT, field=TEXT, subfield=TEXT, topic=TEXT, level=COUNT, score=SCORE))
REFERENCE = _struct(
    title=TEXT, doi=TEXT, journal=TEXT, publish_date=TEXT, authors=TEXTS, abstract=TEXT, citation_count=COUNT, citation_source=TEXT, citation_counts=COUNTS, metadata_sources=TEXTS,
    relevance_score=SCORE, relevance_reason=TEXT, value_score=SCORE, value_reason=TEXT, journal_tier=TEXT, journal_tier_score=SCORE, source_article_doi=TEXT, source_article_title=TEXT,
    source_article_count=COUNT, source_article_titles=TEXTS, source_article_dois=TEXTS, pdf_url=TEXT, local_pdf_path=TEXT, download_status=TEXT, pdf_status=TEXT, error=TEXT,
)
ARTICLE = _struct(
    title=TEXT, doi=TEXT, journal=TEXT, article_url=TEXT, pdf_url=TEXT, local_pdf_path=TEXT, article_type=TEXT, publish_date=TEXT, authors=TEXTS, institutions=TEXTS, abstract=TEXT, subdomain=TEXT,
    classification_confidence=SCORE, classification_reason=TEXT, classification_source=TEXT, classification_source_label=TEXT, classification_taxonomy=TEXT, classification_evidence=EVIDENCE,
    authoritative_topics=TOPICS, problem_statement=TEXT, solution_summary=TEXT, citation_count=COUNT, citation_source=TEXT, citation_counts=COUNTS, citation_policy=TEXT, abstract_source=TEXT,
    metadata_sources=TEXTS, enrichment_status=TEXT, download_status=TEXT, pdf_status=TEXT, error=TEXT, pdf_resolution_status=TEXT, references=T.ArrayType(REFERENCE),
)

#: What an absent field becomes where that is not the empty string, array or map, or zero.
DEFAULTS = {"subdomain": "Other", "download_status": "pending", "pdf_status": "unchecked", "source_article_count": 1}
#: Fields that stay null: null and zero citations differ for completeness, and a missing solution is no empty one.
NULLABLE = {"citation_count", "solution_summary"}


def _filled(name: str, kind: T.DataType, col):
    if name in NULLABLE:
        return col
    if isinstance(kind, T.StringType):
        return F.coalesce(col, F.lit(DEFAULTS.get(name, "")))
    if isinstance(kind, T.NumericType):
        return F.coalesce(col, F.lit(DEFAULTS.get(name, 0)).cast(kind))
    if isinstance(kind, T.ArrayType) and kind.elementType == REFERENCE:
        return F.coalesce(F.transform(col, lambda r: F.struct(*[_filled(f.name, f.dataType, r[f.name]).alias(f.name) for f in REFERENCE.fields])), F.array().cast(kind))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(col, F.array().cast(kind))
    return F.coalesce(col, F.create_map().cast(kind))


def normalise_articles(df: DataFrame) -> DataFrame:
    """Unknown columns go, absent ones and nulls get their defaults, nested references as well; ``_ord`` stays."""
    cols = [_filled(f.name, f.dataType, F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in ARTICLE.fields]
    return df.select(*cols, *(["_ord"] if "_ord" in df.columns else []))
