"""What becomes of each paper's file: there already, renamed, saved, refused, or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import MARKED, NAMED
from . import pdf


def doi_name(doi: Column) -> Column:
    """The name that a file had when it was named after its DOI; null without one."""
    part = F.trim(F.regexp_replace(F.coalesce(doi, F.lit("")), r"[/\\]", "_"))
    return F.when(part != "", F.concat(pdf.safe_name(part, 160), F.lit(".pdf")))


def variant_key(name: Column) -> Column:
    """``sources.files.variant_key`` as an expression."""
    return F.when(F.rlike(name, F.lit(f"(?s){NAMED}")), F.concat(F.regexp_extract(name, f"(?s){NAMED}", 1), F.substring(F.regexp_extract(name, f"(?s){NAMED}", 2), 1, MARKED))).otherwise(name)


def planned(articles: DataFrame, files: DataFrame) -> DataFrame:
    """``articles`` (id, folder, name, doi, pdf_url, ...) against the files that are there (folder, name): adds ``found``, the
    name of the paper's file (its final name before the one of its DOI before others of the same title, of these the first),
    and ``step``: skipped_existing, skipped_existing_renamed, skipped (there is no address), or fetch.

    Three joins by exact keys, each with one row for a key on the files' side; so no folder with many files is a hot key."""
    there = files.select("folder", "name").distinct()
    keyed = there.select("folder", variant_key(F.col("name")).alias("_key"), "name").groupBy("folder", "_key").agg(F.min("name").alias("_variant"))
    rows = articles.withColumns({"_doi": doi_name(F.col("doi")), "_key": variant_key(F.col("name"))})
    rows = rows.join(there.withColumn("_final", F.lit(True)), ["folder", "name"], "left")
    rows = rows.join(there.select("folder", F.col("name").alias("_doi"), F.lit(True).alias("_old")), ["folder", "_doi"], "left")
    rows = rows.join(keyed, ["folder", "_key"], "left")
    found = F.when(F.col("_final"), F.col("name")).when(F.col("_old"), F.col("_doi")).otherwise(F.col("_variant"))
    rows = rows.withColumn("found", found)
    step = F.when(F.col("_final"), "skipped_existing").when(F.col("found").isNotNull(), "skipped_existing_renamed").when(F.coalesce("pdf_url", F.lit("")) == "", "skipped").otherwise("fetch")
    return rows.withColumn("step", step).drop("_doi", "_key", "_final", "_old", "_variant")


def settled(plan: DataFrame, answers: DataFrame, least: int = pdf.LEAST_BYTES) -> DataFrame:
    """``planned`` rows with the answers to those that are to be fetched (id, content binary, error): download_status,
    pdf_status, error, local_path. An answer that isn't a complete paper is skipped with its first fault as pdf_status, a
    failed call is failed; a paper that was to be fetched and has no answer is pending."""
    rows = plan.join(answers.select("id", "content", F.col("error").alias("_error"), F.lit(True).alias("_answered")), "id", "left")
    state = pdf.state(F.col("content"), F.octet_length("content"), least=least)
    there = F.col("step").startswith("skipped_existing")
    status = F.when(F.col("step") != "fetch", F.col("step")).when(F.col("_answered").isNull(), "pending").when(F.col("_error").isNotNull(), "failed").when(state == "complete", "downloaded").otherwise("skipped")
    quality = F.when(there, "complete").when(F.col("step") == "skipped", "missing_pdf_url").when(F.col("_answered").isNull(), "unchecked").when(F.col("_error").isNotNull(), "error").otherwise(state)
    out = rows.withColumns({"download_status": status, "pdf_status": quality, "error": F.coalesce(F.when(F.col("step") == "fetch", F.col("_error")), F.lit(""))})
    path = F.when(F.col("pdf_status") == "complete", F.concat_ws("/", "folder", "name")).otherwise("")
    return out.withColumn("local_path", path).drop("_error", "_answered")


def to_save(rows: DataFrame) -> DataFrame:
    """Of ``settled`` rows what ``sources.files`` has to write or rename: (folder, name, content, other_names)."""
    kept = rows.where("download_status IN ('downloaded', 'skipped_existing', 'skipped_existing_renamed')")
    content = F.when(F.col("download_status") == "downloaded", F.col("content"))
    return kept.select("folder", "name", content.alias("content"), F.filter(F.array(F.col("found"), doi_name(F.col("doi"))), lambda n: n.isNotNull()).alias("other_names"))


def to_classified(articles: DataFrame, stored: DataFrame, root: str = "classified") -> DataFrame:
    """Complete papers (local_path, subdomain) with their stored files (path, content, as the binaryFile source reads them below
    the folder that local paths are relative to) as rows for ``sources.files``: copied into a folder of their subdomain."""
    parts = F.split("local_path", "/")
    wanted = articles.where("pdf_status = 'complete' AND local_path <> ''").select("local_path", F.concat_ws("/", F.lit(root), pdf.safe_name(F.col("subdomain"), 160)).alias("folder"), F.element_at(parts, -1).alias("name"))
    steps = F.split("path", "/")
    # a path's end is what a local path says
    ends = stored.select("content", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, -i, i), "/"))).alias("local_path"))
    return wanted.join(ends, "local_path").select("folder", "name", "content")
