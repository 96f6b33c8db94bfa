"""Order tables seen as papers: each order a paper, its suppliers the authors, its parts the cited works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines have no authors and a null citation count. Names stand in the order of their first line."""
    t = lambda n: table(spark, sf_dir, n)
    who = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").join(who, F.col("l_suppkey") == F.col("s_suppkey"), "left")

    def names(c: str):
        return F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda x: x[c]), lambda x: x.isNotNull()))

    by = line.groupBy("l_orderkey").agg(names("s_name").alias("authors"), names("n_name").alias("institutions"), F.floor(F.sum("l_quantity")).cast("int").alias("citation_count"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    source = F.array(*[F.lit(s) for s in ("openalex", "crossref", "pubmed_mesh", "local_rule", "none", "")])
    return rows.select(
        k.cast("long").alias("_ord"), F.concat(F.lit("Paper "), k.cast("string"), F.when(k % 13 == 0, " a review").otherwise("")).alias("title"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("10.1000/"), k.cast("string"))).alias("doi"),
        F.coalesce("c_mktsegment", F.lit("")).alias("journal"), F.col("o_orderstatus").alias("article_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publish_date"), F.lit("").alias("abstract"), F.col("o_orderpriority").alias("subdomain"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("institutions", F.array().cast("array<string>")).alias("institutions"), "citation_count", ((k % 100) / 100).alias("classification_confidence"),
        F.get(source, (k % 6).cast("int")).alias("classification_source"), F.when(k % 11 == 0, "complete").otherwise("unchecked").alias("pdf_status"), F.when(k % 11 == 0, F.concat(F.lit("/pdf/"), k.cast("string"))).otherwise("").alias("local_pdf_path"),
        F.lit("").alias("problem_statement"), F.lit(None).cast("string").alias("solution_summary"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cited works, in the shape of ``operators.references.unnest``."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, p = F.col("l_orderkey"), F.col("p_partkey")
    return line.select(
        k.cast("long").alias("_ord"), (F.col("l_linenumber").cast("long") * 10_000_000 + p).alias("pos"), F.concat(F.lit("10.1000/"), k.cast("string")).alias("source_doi"), F.concat(F.lit("Paper "), k.cast("string")).alias("source_title"),
        F.col("p_name").alias("title"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("10.2000/"), p.cast("string"))).alias("doi"), F.col("p_brand").alias("journal"), F.when(p % 5 == 0, "").otherwise(F.concat((1990 + p % 30).cast("string"), F.lit("-01"))).alias("publish_date"),
        F.lit("").alias("abstract"), F.lit("").alias("pdf_url"), F.array().cast("array<string>").alias("authors"), F.when(p % 17 != 0, F.floor("p_retailprice").cast("int")).alias("citation_count"), F.lit(1).alias("source_article_count"), ((p % 10) / 10).alias("relevance_score"), ((p % 7) / 7).alias("value_score"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first sentence is the title, the language the subdomain, the source the journal."""
    from ..functions.text import sentences

    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_ord"), F.coalesce(F.get(sentences(t), F.lit(0)), F.lit("")).alias("title"), t.alias("abstract"), F.col("source").alias("journal"), F.lit("article").alias("article_type"), F.col("lang").alias("subdomain"))
