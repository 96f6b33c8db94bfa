"""Addresses of open-access files: by the DOI's publisher, else from what services answered, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_doi
from ..operators.filters import looks_like_pdf_url

#: The parts of the services' answers that name a file.
ANSWERS = {
    "europe-pmc": "resultList struct<result:array<struct<pmcid:string,fullTextUrlList:struct<fullTextUrl:array<struct<url:string,documentStyle:string,availabilityCode:string>>>>>>",
    "unpaywall": "best_oa_location struct<url_for_pdf:string>, oa_locations array<struct<url_for_pdf:string>>",
    "core": "results array<struct<downloadUrl:string,fullTextIdentifier:string>>",
}
#: Availability codes of files that anybody may read.
OPEN = ("oa", "f", "")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _europe_pmc(a: Column) -> Column:
    """The first open PDF of the first hit, else its page at PubMed Central."""
    hit = F.get(a["resultList"]["result"], F.lit(0))
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    files = F.coalesce(hit["fullTextUrlList"]["fullTextUrl"], _none("struct<url:string,documentStyle:string,availabilityCode:string>"))
    good = F.filter(files, lambda f: (F.contains(low(f["documentStyle"]), F.lit("pdf")) | looks_like_pdf_url(f["url"])) & low(f["availabilityCode"]).isin(*OPEN))
    return F.coalesce(F.get(good, F.lit(0))["url"], F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), F.nullif(hit["pmcid"], F.lit("")), F.lit("/pdf/")))


def _unpaywall(a: Column) -> Column:
    """The best location's PDF, else the first of the others that has one."""
    places = F.concat(F.array(a["best_oa_location"]), F.coalesce(a["oa_locations"], _none("struct<url_for_pdf:string>")))
    return F.get(F.filter(F.transform(places, lambda p: p["url_for_pdf"]), looks_like_pdf_url), F.lit(0))


def _core(a: Column) -> Column:
    first = F.get(a["results"], F.lit(0))
    return F.coalesce(F.nullif(first["downloadUrl"], F.lit("")), first["fullTextIdentifier"])


SERVICES = {"europe-pmc": _europe_pmc, "unpaywall": _unpaywall, "core": _core}


def publisher_url(doi: Column) -> dict[str, Column]:
    """Addresses that follow from a (cleaned, lower-cased) DOI."""
    return {
        "plos": F.when(F.startswith(doi, F.lit("10.1371/journal.")), F.concat(F.lit("https://journals.plos.org/plosone/article/file?id="), doi, F.lit("&type=printable"))),
        "mdpi": F.when(F.startswith(doi, F.lit("10.3390/")), F.concat(F.lit("https://www.mdpi.com/"), doi, F.lit("/pdf"))),
    }


def resolved(articles: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, doi, pdf_url, ...) with the answers of services (id, service, body): adds resolved_pdf_url, resolver and
    pdf_resolution_status. What is there stays (resolver ``provider``); else the first of plos, mdpi, europe-pmc, unpaywall and
    core whose address looks like a PDF's; "" without one or without a DOI. Answers that are no JSON count as none; of several
    of one service the greatest body counts."""
    bodies = answers.groupBy("id").agg(*[F.max(F.when(F.col("service") == s, F.col("body"))).alias(f"_{s}") for s in SERVICES])
    rows = articles.join(bodies, "id", "left")
    doi = F.nullif(F.lower(F.trim(clean_doi(F.col("doi")))), F.lit(""))
    found = publisher_url(doi) | {s: make(F.from_json(F.col(f"`_{s}`"), ANSWERS[s])) for s, make in SERVICES.items()}
    there = F.nullif("pdf_url", F.lit(""))
    entry = lambda name, url: F.struct(url.alias("url"), F.lit(name).alias("name"))
    chain = F.filter(F.array(*[entry(n, u) for n, u in found.items()]), lambda e: looks_like_pdf_url(e["url"]))
    best = F.when(there.isNotNull(), entry("provider", there)).when(doi.isNotNull(), F.get(chain, F.lit(0)))
    rows = rows.withColumn("_best", best).drop(*[f"_{s}" for s in SERVICES])
    status = F.when(F.col("_best.name") == "provider", "provider_pdf_url").when(F.col("_best.url").isNotNull(), "oa_pdf_resolved").otherwise("oa_pdf_not_found")
    return rows.withColumns({"resolved_pdf_url": F.coalesce("_best.url", F.lit("")), "resolver": F.coalesce("_best.name", F.lit("")), "pdf_resolution_status": status}).drop("_best")
