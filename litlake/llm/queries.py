"""The registered queries of the operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _url_sql() -> str:
    from .url_filter import duckdb_sql

    return duckdb_sql()


ORACLES["op5_url_filter"] = _url_sql()


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def _secret_sql() -> str:
    from .secrets import duckdb_sql

    return duckdb_sql()


ORACLES["op4_secret_ownership"] = _secret_sql()


@query
def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fold, score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import merged, repeated_passages

    out = merged(repeated_passages(table(spark, sf_dir, "documents")))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", "other_ids", spans.alias("spans"), "removed")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest

    return digest(spark, table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import audit

    return audit(table(spark, sf_dir, "documents"))


def _merkle_sql() -> str:
    from .merkle import duckdb_sql

    return duckdb_sql()


ORACLES["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def _collocation_sql() -> str:
    from .collocations import duckdb_sql

    return duckdb_sql()


ORACLES["op12_phrase_collocations"] = _collocation_sql()


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))
