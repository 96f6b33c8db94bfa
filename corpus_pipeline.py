"""From raw documents to packed training sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from litlake.llm import near_dedup, packing, pii, quality, substring_dedup
from litlake.llm._shared import cut


def _packed_up(docs: DataFrame) -> DataFrame:
    """The text, and the whole row as one column, so that no name of ``docs`` meets one that a stage makes."""
    return docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The rows with a new text; n_chars counts it, if there is such a column."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("whole").getField(c).alias(c) for c in columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, doesn't reject. Rows are judged one by one, null texts as empty
    ones; without any label all stay."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(_packed_up(docs), model).where("predicted = 1").select("whole.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, of repeated rows one. Rows without an id or without a
    word in their text stay."""
    return near_dedup.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has as well. No row goes; null texts stay null."""
    out = substring_dedup.remove_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which personal data is replaced by its kind. No row goes; null texts stay null."""
    return _with_text(pii.find_pii(_packed_up(docs), mask=True), docs.columns, "masked")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; null texts count as empty ones."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("PII", without_personal_data),
    ("packing", packed),
]
#: The learned classifiers, min-hashes and tokens aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; each result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
