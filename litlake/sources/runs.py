"""What a run has left: its files, its packages, and rules and settings that it reads."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Suffixes of files that a run's page shows.
SHOWN = ("json", "csv", "html", "md", "pdf")


def run_files(spark: SparkSession, path: str, suffixes: Sequence[str] = SHOWN) -> DataFrame:
    """(path, kind, length, modified) of the files below a folder, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("kind", kind).where(F.col("kind").isin(*suffixes)).select("path", "kind", "length", "modified").orderBy("path")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, files, modified) of the folders below ``path``, the latest first."""
    rows = run_files(spark, path).withColumn("run", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return rows.groupBy("run").agg(F.count("*").alias("files"), F.max("modified").alias("modified")).orderBy(F.desc("modified"), "run")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all packages below a folder, in either layout, each once: (path, domain_name, paper_count, manifest)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "domain_manifest.json").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value").dropDuplicates(["path"])
    body = F.try_parse_json("value")
    return rows.select("path", F.try_variant_get(body, "$.domain_name", "string").alias("domain_name"), F.try_variant_get(body, "$.paper_count", "int").alias("paper_count"), F.col("value").alias("manifest"))


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """Domain rules from a JSON file: a list of objects with domain and terms, or an object whose ``rules`` is one. Blank terms,
    and rules without a name or a term, are left out. The few rules come to the driver, where they become expressions."""
    body = F.try_parse_json("value")
    kind = "array<struct<domain:string,terms:array<string>>>"
    rules = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.try_variant_get(body, "$.rules", kind), F.try_variant_get(body, "$", kind))).alias("r"))
    terms = F.filter(F.transform("r.terms", lambda t: F.trim(t)), lambda t: t != "")
    rows = rules.select(F.trim("r.domain").alias("domain"), terms.alias("terms")).where("domain <> '' and size(terms) > 0")
    return [(r["domain"], tuple(r["terms"])) for r in rows.collect()]


def read_settings(spark: SparkSession, path: str, known: dict[str, str]) -> dict[str, str]:
    """``known`` settings and those of a file of NAME=value lines that aren't known yet; quotes and comments go."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", 1).alias("k"), F.regexp_extract("value", r"^\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=\s*(.*?)\s*$", 1).alias("v"))
    found = {r["k"]: r["v"].strip("\"'") for r in lines.where("k <> ''").collect()}
    return found | known


def answer_text(body: Column) -> Column:
    """The text of a model's answer, of either protocol: the first text of ``output``, ``output_text``, or the first choice's
    message; a code fence around it goes. Null without any."""
    from ..functions.text import strip_code_fence

    v = F.try_parse_json(F.coalesce(body, F.lit("")))
    items = F.try_variant_get(v, "$.output", "array<struct<content:array<struct<type:string,text:string>>>>")
    texts = F.transform(F.filter(F.flatten(F.transform(items, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda c: c["type"].isin("output_text", "text") & (F.coalesce(c["text"], F.lit("")) != "")), lambda c: c["text"])
    choice = F.try_variant_get(v, "$.choices[0].message.content", "string")
    return strip_code_fence(F.coalesce(F.get(texts, F.lit(0)), F.try_variant_get(v, "$.output_text", "string"), F.nullif(choice, F.lit(""))))


def paced(fetch: Callable[[str], str], least: float = 1.0, retries: int = 2, pause: float = 0.5) -> Callable[[str], str]:
    """``fetch`` with at least ``least`` seconds from call to call of this worker, tried again with growing pauses if it fails."""
    last = [0.0]

    def call(address: str) -> str:
        for n in range(retries + 1):
            time.sleep(max(0.0, last[0] + least - time.monotonic()))
            last[0] = time.monotonic()
            try:
                return fetch(address)
            except OSError:
                if n == retries:
                    raise
                time.sleep(pause * 2**n * (1 + random.random() / 4))
        raise AssertionError

    return call
