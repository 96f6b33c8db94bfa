"""Cached answers of metadata services, read as expressions: a column of JSON texts becomes the fields of a paper, or evidence of
its subject. A lookup is a left join of the papers with the answers by DOI, or by title where a paper has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_abstract, clean_doi, date_parts, dedupe, int_or_none, inverted_abstract
from ..operators.filters import can_help, looks_biomedical

FIELDS = ("title", "doi", "journal", "publish_date", "article_type", "authors", "institutions", "abstract", "citation_count")
_NAMED = "array<struct<name:string>>"
#: What of an answer is read, by service.
ANSWERS = {
    "openalex": "title string, display_name string, doi string, primary_location struct<source:struct<display_name:string>>, publication_date string, publication_year int, type string,"
    " authorships array<struct<author:struct<display_name:string>, institutions:array<struct<display_name:string>>>>, abstract_inverted_index map<string,array<int>>, cited_by_count string",
    "semantic-scholar": f"title string, externalIds struct<DOI:string>, venue string, publicationDate string, year int, publicationTypes array<string>, authors {_NAMED}, abstract string, citationCount string",
    "europe-pmc": "title string, doi string, journalTitle string, firstPublicationDate string, pubYear string, pubType string, authorString string, abstractText string, citedByCount string",
    "crossref": "title array<string>, DOI string, `container-title` array<string>, type string, author array<struct<given:string, family:string, name:string, affiliation:array<struct<name:string>>>>,"
    " abstract string, `is-referenced-by-count` string, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>,"
    " subject array<string>, URL string, link array<struct<URL:string, `content-type`:string>>",
}
#: Fields that a service can fill; papers that lack none of them aren't asked about.
SUPPORTED = {
    "openalex": ("doi", "journal", "article_type", "abstract", "authors", "institutions", "publish_date", "citation_count"),
    "semantic-scholar": ("doi", "journal", "article_type", "abstract", "authors", "publish_date", "citation_count"),
    "europe-pmc": ("doi", "journal", "article_type", "abstract", "authors", "publish_date", "citation_count"),
    "crossref": ("doi", "journal", "article_type", "publish_date", "authors", "institutions", "abstract", "citation_count"),
}


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _openalex(a: Column) -> dict[str, Column]:
    return {
        "title": F.coalesce(_some(a["title"]), a["display_name"]), "doi": a["doi"], "journal": a["primary_location"]["source"]["display_name"], "publish_date": F.coalesce(_some(a["publication_date"]), a["publication_year"].cast("string")), "article_type": a["type"],
        "authors": dedupe(F.transform(a["authorships"], lambda x: x["author"]["display_name"])), "institutions": dedupe(F.flatten(F.transform(a["authorships"], lambda x: F.transform(F.coalesce(x["institutions"], F.array().cast("array<struct<display_name:string>>")), lambda i: i["display_name"])))),
        "abstract": inverted_abstract(a["abstract_inverted_index"]), "citation_count": a["cited_by_count"],
    }


def _semantic_scholar(a: Column) -> dict[str, Column]:
    return {
        "title": a["title"], "doi": a["externalIds"]["DOI"], "journal": a["venue"], "publish_date": F.coalesce(_some(a["publicationDate"]), a["year"].cast("string")), "article_type": F.get(a["publicationTypes"], F.lit(0)),
        "authors": F.transform(a["authors"], lambda x: F.coalesce(x["name"], F.lit(""))), "abstract": a["abstract"], "citation_count": a["citationCount"],
    }


def _europe_pmc(a: Column) -> dict[str, Column]:
    return {
        "title": a["title"], "doi": a["doi"], "journal": a["journalTitle"], "publish_date": F.coalesce(_some(a["firstPublicationDate"]), a["pubYear"]), "article_type": a["pubType"],
        "authors": dedupe(F.split(F.coalesce(a["authorString"], F.lit("")), "[;,]"), distinct=False), "abstract": a["abstractText"], "citation_count": a["citedByCount"],
    }


def _crossref(a: Column) -> dict[str, Column]:
    name = lambda x: F.coalesce(_some(F.trim(F.concat_ws(" ", x["given"], x["family"]))), x["name"])
    date = F.coalesce(*[_some(date_parts(a[k]["date-parts"])) for k in ("published-print", "published-online", "published")])
    return {
        "title": F.get(a["title"], F.lit(0)), "doi": a["DOI"], "journal": F.get(a["container-title"], F.lit(0)), "publish_date": date, "article_type": a["type"],
        "authors": dedupe(F.transform(a["author"], name)), "institutions": dedupe(F.flatten(F.transform(a["author"], lambda x: F.transform(F.coalesce(x["affiliation"], F.array().cast(_NAMED)), lambda i: i["name"])))),
        "abstract": a["abstract"], "citation_count": a["is-referenced-by-count"],
    }


RESOLVERS: dict[str, Callable[[Column], dict[str, Column]]] = {"openalex": _openalex, "semantic-scholar": _semantic_scholar, "europe-pmc": _europe_pmc, "crossref": _crossref}


def cleaned(fields: dict[str, Column]) -> dict[str, Column]:
    """DOI, abstract and count cleaned; what is empty is null."""
    out = {}
    for k in FIELDS:
        if k in ("authors", "institutions"):
            x = fields.get(k, F.lit(None).cast("array<string>"))
            out[k] = F.when(F.size(x) > 0, x)
        elif k == "citation_count":
            out[k] = int_or_none(fields[k])
        else:
            x = fields[k]
            out[k] = _some({"doi": clean_doi, "abstract": clean_abstract}.get(k, lambda v: v)(x))
    return out


def lookup_key(doi: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(_some(clean_doi(doi)))), F.concat(F.lit("title:"), _some(title)))


def asked(source: str) -> Column:
    """Whether a service is asked about a paper: it lacks something that the service has; and for Europe PMC it's biomedical."""
    ok = can_help(SUPPORTED[source])
    return ok & looks_biomedical(F.concat_ws(" ", "title", "abstract", "journal", "article_type")) if source == "europe-pmc" else ok


def resolve(articles: DataFrame, answers: DataFrame, source: str) -> DataFrame:
    """(_ord, title, doi, journal, ...) of the papers that ``source`` is asked about and has an answer (key, body) for."""
    rows = articles.where(asked(source)).select("_ord", lookup_key(F.col("doi"), F.col("title")).alias("key")).join(answers.select("key", "body"), "key")
    found = rows.withColumn("a", F.from_json("body", ANSWERS[source]))
    return found.where("a is not null").select("_ord", *[v.alias(k) for k, v in cleaned(RESOLVERS[source](F.col("a"))).items()])


def enriched(rows: DataFrame, found: DataFrame, key: str = "_ord") -> DataFrame:
    """``rows`` (references or papers) with every field of FIELDS that ``found`` has replaced by it; others stay."""
    new = found.select(key, *[F.col(c).alias(f"_{c}") for c in FIELDS])
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in FIELDS if c in rows.columns}).drop(*[f"_{c}" for c in FIELDS])


def mesh_evidence(answers: DataFrame) -> DataFrame:
    """(id, body of a summary) -> its headings, given as texts or as objects with a name or term."""
    items = F.try_variant_get(F.try_parse_json("body"), "$.meshheadinglist", "array<variant>")
    rows = answers.select("id", F.posexplode(items).alias("pos", "x"))
    text = F.when(F.startswith(F.schema_of_variant("x"), F.lit("STRING")), F.try_variant_get("x", "$", "string")).otherwise(F.coalesce(_some(F.try_variant_get("x", "$.name", "string")), F.try_variant_get("x", "$.term", "string")))
    return _evidence(rows.select("id", "pos", text.alias("label")), "pubmed_mesh", F.lit("MeSH"), F.lit(0.95))


def crossref_evidence(answers: DataFrame) -> DataFrame:
    rows = answers.select("id", F.posexplode(F.from_json("body", ANSWERS["crossref"])["subject"]).alias("pos", "label"))
    return _evidence(rows, "crossref", F.lit("Crossref subject"), F.lit(0.72))


def openalex_evidence(topics: DataFrame) -> DataFrame:
    """(id, authoritative_topics) -> those from OpenAlex with a label; topics weigh more than concepts."""
    rows = topics.select("id", F.posexplode("authoritative_topics").alias("pos", "t")).where("t.source = 'openalex'")
    taxonomy = F.coalesce(_some(F.col("t.taxonomy")), F.lit("OpenAlex Topics/Concepts"))
    rows = rows.select("id", "pos", F.col("t.label").alias("label"), taxonomy.alias("taxonomy"))
    return _evidence(rows, "openalex", F.col("taxonomy"), F.when(F.col("taxonomy") == "OpenAlex Topics", 0.82).otherwise(0.76))


def _evidence(rows: DataFrame, source: str, taxonomy: Column, confidence: Column) -> DataFrame:
    label = F.trim(F.coalesce("label", F.lit("")))
    return rows.where(label != "").select("id", "pos", F.lit(source).alias("source"), taxonomy.alias("taxonomy"), label.alias("label"), label.alias("domain"), confidence.alias("confidence"))


def search_hits(answers: DataFrame, source: str) -> DataFrame:
    """(_ord, body) of a search -> papers with article_url, pdf_url and where they come from; "crossref" or "europe-pmc"."""
    rows = answers.withColumn("a", F.from_json("body", ANSWERS[source]))
    a = F.col("a")
    f = cleaned(RESOLVERS[source](a))
    doi = F.coalesce(f["doi"], F.lit(""))
    page = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    body = F.try_parse_json("body")
    if source == "crossref":
        links = F.filter(a["link"], lambda x: F.contains(F.lower(F.coalesce(x["content-type"], F.lit(""))), F.lit("pdf")) | F.endswith(F.lower(F.coalesce(x["URL"], F.lit(""))), F.lit(".pdf")))
        url, pdf = F.coalesce(_some(a["URL"]), page), F.get(F.transform(links, lambda x: x["URL"]), F.lit(0))
    else:
        entries = F.try_variant_get(body, "$.fullTextUrlList.fullTextUrl", "array<struct<url:string,documentStyle:string>>")
        good = F.filter(entries, lambda x: F.contains(F.lower(F.coalesce(x["documentStyle"], F.lit(""))), F.lit("pdf")) | F.endswith(F.lower(F.coalesce(x["url"], F.lit(""))), F.lit(".pdf")))
        pmcid = F.coalesce(*[_some(F.try_variant_get(body, f"$.{k}", "string")) for k in ("pmcid", "pmcId")])
        url = F.coalesce(_some(F.try_variant_get(body, "$.fullTextUrl", "string")), page)
        pdf = F.coalesce(F.get(F.transform(good, lambda x: x["url"]), F.lit(0)), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/pdf/")))
    texts = ("title", "doi", "journal", "publish_date", "article_type", "abstract")
    return rows.select("_ord", *[F.coalesce(f[c], F.lit("")).alias(c) for c in texts], F.coalesce(f["authors"], F.array().cast("array<string>")).alias("authors"), f["citation_count"].alias("citation_count"), url.alias("article_url"), F.coalesce(pdf, F.lit("")).alias("pdf_url"), F.lit(source).alias("citation_source"))
