"""Metadata of papers: manifests, cached pages of the open APIs, and what journals there are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import clean_abstract, clean_doi, date_parts, dedupe, inverted_abstract
from ..schema import ARTICLE, normalise_articles

OPENALEX = (
    "title string, doi string, type string, publication_date string, publication_year int, cited_by_count int, abstract_inverted_index map<string,array<int>>, "
    "primary_location struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>, open_access struct<oa_url:string>, "
    "topics array<struct<display_name:string,field:struct<display_name:string>,subfield:struct<display_name:string>,score:double>>, concepts array<struct<display_name:string,level:int,score:double>>, "
    "authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>"
)
CROSSREF = (
    "title array<string>, DOI string, `container-title` array<string>, URL string, type string, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, "
    "published struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>, abstract string, link array<struct<URL:string,`content-type`:string>>, "
    "subject array<string>, `is-referenced-by-count` int"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of papers, or JSON lines; ``_ord`` is the place in the array (in the scan for lines)."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.where(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", f"array<{ARTICLE.simpleString()}>")).alias("_ord", "a")).select(F.col("_ord").cast("long").alias("_ord"), "a.*")
    if rows.isEmpty():
        rows = spark.read.schema(ARTICLE).json(path).withColumn("_ord", F.monotonically_increasing_id())
    return normalise_articles(rows)


def openalex_topics() -> Column:
    """Topics, then concepts of level 2 or less, as evidence; labels read field > subfield > topic."""
    path = lambda *xs: F.array_join(dedupe(F.array(*xs)), " > ")
    text = lambda x: F.coalesce(x, F.lit(""))
    topic = F.transform("topics", lambda t: F.struct(F.lit("openalex").alias("source"), F.lit("topic").alias("taxonomy"), path(text(t["field"]["display_name"]), text(t["subfield"]["display_name"]), text(t["display_name"])).alias("label"),
        text(t["field"]["display_name"]).alias("field"), text(t["subfield"]["display_name"]).alias("subfield"), text(t["display_name"]).alias("topic"), F.lit(None).cast("int").alias("level"), t["score"].alias("score")))
    concept = F.transform(F.filter("concepts", lambda c: c["level"] <= 2), lambda c: F.struct(F.lit("openalex").alias("source"), F.lit("concept").alias("taxonomy"), text(c["display_name"]).alias("label"), F.lit("").alias("field"), F.lit("").alias("subfield"), F.lit("").alias("topic"), c["level"].alias("level"), c["score"].alias("score")))
    empty = F.array().cast("array<struct<source:string,taxonomy:string,label:string,field:string,subfield:string,topic:string,level:int,score:double>>")
    return F.concat(F.coalesce(topic, empty), F.coalesce(concept, empty))


def openalex_articles(works: DataFrame) -> DataFrame:
    """Works (schema OPENALEX) as articles."""
    c, place = F.col, F.col("primary_location")
    names = F.array().cast("array<string>")
    return normalise_articles(works.select(
        F.coalesce("title", F.lit("")).alias("title"), clean_doi(c("doi")).alias("doi"), place["source"]["display_name"].alias("journal"), place["landing_page_url"].alias("article_url"), F.coalesce(place["pdf_url"], c("open_access")["oa_url"]).alias("pdf_url"),
        c("type").alias("article_type"), F.coalesce("publication_date", c("publication_year").cast("string")).alias("publish_date"), dedupe(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"),
        dedupe(F.flatten(F.transform("authorships", lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), names)))).alias("institutions"), inverted_abstract(c("abstract_inverted_index")).alias("abstract"),
        openalex_topics().alias("authoritative_topics"), c("cited_by_count").alias("citation_count"), F.when(c("cited_by_count").isNotNull(), "openalex").alias("citation_source"), F.array(F.lit("openalex")).alias("metadata_sources"), *[c(x) for x in ("_ord",) if x in works.columns],
    ))


def crossref_articles(items: DataFrame) -> DataFrame:
    """Items (schema CROSSREF) as articles; the date is the first of print, online, published."""
    c = F.col
    date = F.coalesce(*[F.nullif(date_parts(c(n)["date-parts"]), F.lit("")) for n in ("`published-print`", "`published-online`", "published")], F.lit(""))
    pdf = F.get(F.filter("link", lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
    names = F.array().cast("array<string>")
    return normalise_articles(items.select(
        F.coalesce(F.get("title", F.lit(0)), F.lit("")).alias("title"), clean_doi(c("DOI")).alias("doi"), F.get("`container-title`", F.lit(0)).alias("journal"), c("URL").alias("article_url"), pdf.alias("pdf_url"), c("type").alias("article_type"), date.alias("publish_date"),
        dedupe(F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"]))).alias("authors"), dedupe(F.flatten(F.transform("author", lambda a: F.coalesce(F.transform(a["affiliation"], lambda x: x["name"]), names)))).alias("institutions"),
        clean_abstract(c("abstract")).alias("abstract"), c("`is-referenced-by-count`").alias("citation_count"), F.array(F.lit("crossref")).alias("metadata_sources"), *[c(x) for x in ("_ord",) if x in items.columns],
    ))


def cache_key(url: Column, params: Column) -> Column:
    """Under which a page is kept: the hash of its address and parameters as JSON."""
    return F.sha2(F.to_json(F.struct(params.alias("params"), url.alias("url"))), 256)


@dataclass(frozen=True)
class Journal:
    key: str
    name: str
    provider: str = "layered"
    issn: str = ""
    slug: str = ""
    group: str = ""


def parse_journals(specs: Sequence[str], catalogue: dict[str, Journal]) -> list[Journal]:
    """``key`` of the catalogue, ``provider:Name=ISSN``, or ``Name=slug``."""
    out = []
    for spec in (s.strip() for s in specs):
        provider, _, rest = spec.partition(":") if spec.split(":")[0] in ("layered", "crossref", "openalex") else ("crawler", "", spec)
        name, sign, value = rest.partition("=")
        if not sign:
            if spec.lower() not in catalogue:
                raise ValueError(f"unknown journal: {spec}")
            out.append(catalogue[spec.lower()])
        elif provider == "crawler":
            out.append(Journal(name.lower().replace(" ", "-"), name, provider, slug=value))
        else:
            out.append(Journal(name.lower().replace(" ", "-"), name, provider, issn=value))
    return out


def journals_frame(spark: SparkSession, journals: Sequence[Journal]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(j).values()) for j in journals], "key string, name string, provider string, issn string, slug string, `group` string")


#: Sources by name, case-insensitive; more can be added.
PROVIDERS: dict[str, Callable[..., DataFrame]] = {"openalex": openalex_articles, "crossref": crossref_articles}


def provider(name: str) -> Callable[..., DataFrame]:
    if name.lower() not in PROVIDERS:
        raise KeyError(f"no such provider: {name}")
    return PROVIDERS[name.lower()]
