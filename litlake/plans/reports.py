"""Registered queries over answers of models and services, summaries, packages and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring, text as tx
from ..operators import classify, enrich, evidence, filters, monitor, pdf, ranking, references as refs_, reports, stats, summaries, validation
from ..schema import ARTICLE, normalise_articles
from ..sources import lookups, runs, star
from ..tables import cut
from .catalogue import ARTICLES, AS_OF, COUNTS, POOL, REF_VALUE, REFS, REVIEW, TIERS, VALUED, query

# --- answers of models -------------------------------------------------------------------------------------------------------

#: A contract with one field of each kind.
SMALL = {
    "type": "object", "additionalProperties": False, "required": ["problem", "methods", "confidence"],
    "properties": {"problem": {"type": "string"}, "methods": {"type": "array", "items": {"type": "string"}}, "confidence": {"type": "string", "enum": ["low", "medium", "high"]}},
}


def _answers(spark, sf_dir, problem: str = "problem") -> DataFrame:
    """Labels as JSON answers with every fault in turn."""
    k = F.col("doc_id")
    part = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    parts = F.array(
        part(4, [f'"{problem}": "x"', f'"{problem}": " "', f'"{problem}": 7', None]), part(3, ['"methods": ["a", 1, null]', '"methods": "a"', '"methods": []']),
        F.when(k % 5 == 0, '"confidence": "sure"').otherwise('"confidence": "low"'), F.when(k % 7 == 0, '"note": true'),
    )
    return star.table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "), F.lit("}")).alias("answer"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 3 THEN '$.problem: missing required field' END, CASE WHEN doc_id % 7 = 0 THEN '$.note: unexpected field' END, CASE WHEN doc_id % 4 = 2 THEN '$.problem: expected string, got int' END,
 CASE doc_id % 3 WHEN 0 THEN '$.methods[1]: expected string, got int; $.methods[2]: expected string, got NoneType' WHEN 1 THEN '$.methods: expected array, got str' END,
 CASE WHEN doc_id % 5 = 0 THEN '$.confidence: expected one of [''low'', ''medium'', ''high''], got ''sure''' END, CASE WHEN doc_id % 4 > 0 THEN '$.problem: must be a non-empty string' END], lambda e: e IS NOT NULL), '; ') AS errors FROM labels""")
def validate_answers(spark, sf_dir):
    value = validation.parsed(F.col("answer"))
    errors = F.concat(validation.schema_errors(value, SMALL), validation.blank_errors(value, ["problem", "confidence"]))
    return _answers(spark, sf_dir).select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN ' ' WHEN 2 THEN '7' ELSE '' END AS research_problem, CASE WHEN doc_id % 5 = 0 THEN 'low' ELSE 'low' END AS confidence, 'abstract_only' AS source_basis, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS n_methods, 0 AS n_findings FROM labels")
def repaired_analyses(spark, sf_dir):
    rows = _answers(spark, sf_dir, "research_problem").withColumn("r", validation.repaired_analysis(F.col("answer"), "abstract_only"))
    return rows.select("doc_id", "r.research_problem", "r.confidence", "r.source_basis", F.size("r.methods").alias("n_methods"), F.size("r.core_findings").alias("n_findings"))


def _syntheses(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    body = F.format_string('{"domain": "d%d", "one_sentence_summary": "%s", "research_gaps": [%s], "evidence_index": [{"claim": " c%d ", "papers": ["Paper-%d!", "p%d"]}]}', k, F.when(k % 2 == 0, "s").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit('"g'), k.cast("string"), F.lit('"'))).otherwise(""), k, k, k + 1)
    return star.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), k.cast("string")).alias("domain"), F.when(k % 5 == 0, "{}").otherwise(body).alias("answer"))


def _known(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    rows = star.table(spark, sf_dir, "labels").where("quality = 1")
    return rows.select(F.concat(F.lit("d"), k.cast("string")).alias("domain"), k.alias("ord"), F.concat(F.lit("p"), (k + k % 2).cast("string")).alias("paper_id"), F.concat(F.lit("paper "), k.cast("string")).alias("title"), F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"))


@query("""SELECT 'd' || doc_id AS domain, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN quality IS DISTINCT FROM 1 THEN 'Paper-' || doc_id || '!' END, CASE WHEN quality IS DISTINCT FROM 1 OR doc_id % 2 = 0 THEN 'p' || (doc_id + 1) END], lambda x: x IS NOT NULL), '|') END AS unknown,
 CASE WHEN doc_id % 5 = 0 THEN 12 ELSE 9 END + CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END + CASE WHEN doc_id % 5 = 0 THEN 0 WHEN quality IS DISTINCT FROM 1 THEN 2 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_errors FROM labels""")
def checked_syntheses(spark, sf_dir):
    rows = validation.checked_syntheses(_syntheses(spark, sf_dir), _known(spark, sf_dir))
    return rows.select("domain", F.array_join("unknown_evidence_papers", "|").alias("unknown"), F.size("errors").alias("n_errors"))


@query("SELECT 'd' || doc_id AS domain, doc_id % 5 = 0 AS empty FROM labels")
def empty_syntheses(spark, sf_dir):
    return _syntheses(spark, sf_dir).select("domain", validation.is_empty_synthesis(F.col("answer")).alias("empty"))


@query("""SELECT 'd' || l.doc_id AS domain, 'c' || l.doc_id AS claim, p AS pos, CASE p WHEN 0 THEN 'Paper-' || l.doc_id || '!' ELSE 'p' || (l.doc_id + 1) END AS paper,
 CASE WHEN quality = 1 AND (p = 0 OR l.doc_id % 2 = 1) THEN 'paper ' || l.doc_id ELSE '' END AS title, CASE WHEN quality = 1 AND (p = 0 OR l.doc_id % 2 = 1) THEN '10.1/' || l.doc_id ELSE '' END AS doi FROM labels l, (VALUES (0), (1)) v(p) WHERE l.doc_id % 5 <> 0""")
def evidence_trace(spark, sf_dir):
    claims = validation.cited_papers(_syntheses(spark, sf_dir))
    return reports.trace(claims, _known(spark, sf_dir)).select("domain", "claim", "pos", "paper", "title", "doi")


@query("SELECT l.doc_id, coalesce(d.source, '') AS source, d.doc_id IS NOT NULL AS has_paper FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en' WHERE quality = 1 OR quality IS NULL")
def analyses_with_papers(spark, sf_dir):
    k = F.col("doc_id")
    analyses = star.table(spark, sf_dir, "labels").select(F.lit("x").alias("domain"), k.cast("string").alias("stem"), "doc_id", F.when(F.col("quality") == 1, "valid").when(F.col("quality").isNotNull(), "invalid").alias("validation_status"))
    papers = star.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.lit("x").alias("domain"), k.cast("string").alias("paper_id"), "source")
    return reports.analyses_with_papers(analyses, papers).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "has_paper")


@query("SELECT doc_id, 10 AS n_errors, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_unsupported FROM documents")
def checked_analyses(spark, sf_dir):
    """Every document's first sentence as the snippet that its answer rests on; every fifth has one that no text holds."""
    first = F.coalesce(F.get(tx.sentences(F.col("text")), F.lit(0)), F.lit(""))
    body = F.to_json(F.struct(F.lit("p").alias("research_problem"), F.lit("pdf_text").alias("source_basis"), F.lit("low").alias("confidence"), F.array(F.when(F.col("doc_id") % 5 == 0, F.format_string("q%d 0zxq 9vkj", "doc_id")).otherwise(first)).alias("supporting_text")))
    rows = star.table(spark, sf_dir, "documents").select("doc_id", body.alias("answer"), F.lit("").alias("abstract"), F.col("text").alias("extracted_text"), F.lit(None).cast("array<struct<text:string>>").alias("selected_chunks"))
    return validation.checked_analyses(rows).select("doc_id", F.size("errors").alias("n_errors"), F.size("unsupported_supporting_text").alias("n_unsupported"))


@query("SELECT d AS domain, item - 1 AS place, 'g' || k AS gap FROM (SELECT 'd' || doc_id AS d, doc_id AS k, row_number() OVER (ORDER BY 'd' || doc_id) AS item FROM labels WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0) WHERE item <= 12")
def research_gaps(spark, sf_dir):
    rows = _syntheses(spark, sf_dir).select("domain", F.try_variant_get(validation.parsed(F.col("answer")), "$.research_gaps", "array<string>").alias("gaps"))
    out = reports.gaps(rows.where("size(gaps) > 0"))
    return out.select("domain", (F.row_number().over(Window.orderBy("domain", "pos")) - 1).cast("long").alias("place"), "gap")


# --- answers of services -----------------------------------------------------------------------------------------------------

_BODIES = {
    "semantic-scholar": '{"title": "S %s", "externalIds": {"DOI": "https://doi.org/10.9/%s"}, "venue": "V", "year": 1999, "authors": [{"name": "Ann"}, {"name": "Bo"}], "abstract": "<p>text  %s</p>", "citationCount": "n/a"}',
    "crossref": '{"title": ["C %s"], "DOI": "10.9/%s", "container-title": ["J"], "type": "journal-article", "author": [{"given": "Ann", "family": "Lee %s", "affiliation": [{"name": "X"}, {"name": "X"}]}], "is-referenced-by-count": 5, "published-online": {"date-parts": [[2001, 2]]}, "subject": [" Biology ", "", "Chemistry"]}',
    "openalex": '{"display_name": "O %s", "doi": "https://doi.org/10.9/%s", "publication_year": 2003, "type": "article", "authorships": [{"author": {"display_name": "Ann"}, "institutions": [{"display_name": "X"}]}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "cited_by_count": %s}',
    "europe-pmc": '{"title": "E %s", "doi": "10.9/%s", "pubYear": "2005", "authorString": "Lee A; Kim B", "abstractText": "t %s", "citedByCount": 3}',
}
_FOUND = {
    "semantic-scholar": ("'S '", "'1999'", "'Ann|Bo'", "'text ' || ord", "-1"), "crossref": ("'C '", "'2001/2'", "'Ann Lee ' || ord", "''", "5"), "openalex": ("'O '", "'2003'", "'Ann'", "'a b a'", "ord::INT"), "europe-pmc": ("'E '", "'2005'", "'Lee A|Kim B'", "'t ' || ord", "3"),
}
_LOOKUPS = " UNION ALL ".join(
    f"SELECT ord, '{name}' AS source, {t} || ord AS title, '10.9/' || ord AS doi, {d} AS publish_date, {a} AS authors, {x} AS abstract, {c} AS citation_count FROM articles" + (" WHERE regexp_matches(lower(title || ' ' || journal || ' ' || article_type), 'medic')" if name == "europe-pmc" else "")
    for name, (t, d, a, x, c) in _FOUND.items()
)


def _bodies(rows: DataFrame, name: str) -> DataFrame:
    k = F.col("_ord").cast("string")
    body = F.lit(_BODIES[name])
    return rows.select("_ord", lookups.lookup_key(F.col("doi"), F.col("title")).alias("key"), F.replace(body, F.lit("%s"), k).alias("body"))


@query(f"{ARTICLES} {_LOOKUPS}")
def metadata_lookups(spark, sf_dir):
    rows, out = cut(star.articles(spark, sf_dir), "articles"), None
    for name in lookups.RESOLVERS:
        found = lookups.resolve(rows, _bodies(rows, name), name)
        part = found.select(F.col("_ord").alias("ord"), F.lit(name).alias("source"), "title", "doi", "publish_date", F.array_join("authors", "|").alias("authors"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("citation_count", F.lit(-1)).alias("citation_count"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{ARTICLES} SELECT ord, CASE WHEN ord % 2 = 0 THEN 'C ' || ord ELSE title END AS title, CASE WHEN ord % 2 = 0 THEN 'J' ELSE journal END AS journal, CASE WHEN ord % 2 = 0 THEN 5 ELSE coalesce(citation_count, -1) END AS citation_count FROM articles")
def enriched_references(spark, sf_dir):
    rows = star.articles(spark, sf_dir)
    found = lookups.resolve(rows, _bodies(rows.where("_ord % 2 = 0"), "crossref"), "crossref")
    return lookups.enriched(rows, found).select(F.col("_ord").alias("ord"), "title", "journal", F.coalesce("citation_count", F.lit(-1)).alias("citation_count"))


@query(f"{ARTICLES} SELECT ord AS id, 0 AS pos, 'crossref' AS source, 'Crossref subject' AS taxonomy, 'Biology' AS domain, 0.72::DOUBLE AS confidence FROM articles UNION ALL SELECT ord, 2, 'crossref', 'Crossref subject', 'Chemistry', 0.72::DOUBLE FROM articles")
def subject_evidence(spark, sf_dir):
    rows = _bodies(star.articles(spark, sf_dir), "crossref").select(F.col("_ord").alias("id"), "body")
    return lookups.crossref_evidence(rows).select("id", "pos", "source", "taxonomy", "domain", "confidence")


@query("SELECT doc_id AS id, p AS pos, CASE p WHEN 0 THEN 'Mice' ELSE 'Age ' || doc_id END AS domain, 0.95::DOUBLE AS confidence FROM labels, (VALUES (0), (2)) v(p)")
def mesh_evidence(spark, sf_dir):
    body = F.format_string('{"meshheadinglist": [" Mice", {"name": ""}, {"term": "Age %d"}]}', "doc_id")
    return lookups.mesh_evidence(star.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), body.alias("body"))).select("id", "pos", "domain", "confidence")


@query("SELECT doc_id AS id, p AS pos, CASE p WHEN 0 THEN 'OpenAlex Topics' ELSE 'OpenAlex Concepts' END AS taxonomy, 'L' || (doc_id % 4 + p) AS domain, CASE p WHEN 0 THEN 0.82::DOUBLE ELSE 0.76::DOUBLE END AS confidence FROM labels, (VALUES (0), (1)) v(p)")
def openalex_evidence(spark, sf_dir):
    topic = lambda p, source, kind: F.struct(F.lit(source).alias("source"), F.lit(kind).alias("taxonomy"), F.concat(F.lit("L"), (F.col("doc_id") % 4 + p).cast("string")).alias("label"))
    topics = F.array(topic(0, "openalex", "OpenAlex Topics"), topic(1, "openalex", "OpenAlex Concepts"), topic(2, "other", "x"))
    return lookups.openalex_evidence(star.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), topics.alias("authoritative_topics"))).select("id", "pos", "taxonomy", "domain", "confidence")


@query(f"{ARTICLES} SELECT ord, 'C ' || ord AS title, 'https://doi.org/10.9/' || ord AS article_url, '' AS pdf_url, 'crossref' AS source FROM articles UNION ALL SELECT ord, 'E ' || ord, 'https://doi.org/10.9/' || ord, '', 'europe-pmc' FROM articles")
def search_hits(spark, sf_dir):
    rows = star.articles(spark, sf_dir)
    parts = [lookups.search_hits(_bodies(rows, name), name) for name in ("crossref", "europe-pmc")]
    return parts[0].unionByName(parts[1]).select(F.col("_ord").alias("ord"), "title", "article_url", "pdf_url", F.col("citation_source").alias("source"))


@query()
def title_search(spark, sf_dir):
    """The papers of most like titles: both catalogues' hits, repeats by DOI or title dropped, the twenty nearest."""
    rows = cut(star.articles(spark, sf_dir), "articles")
    again = rows.where("_ord % 3 = 0").withColumns({"_ord": F.col("_ord") + 100_000_000, "title": F.upper("title"), "doi": F.lit("")})
    hits = refs_.title_search(rows.unionByName(again), "Paper 77 a review", 20)
    return hits.select("title", "doi", F.round("similarity", 6).alias("similarity"))


# --- summaries ---------------------------------------------------------------------------------------------------------------

_GROUP = f"SELECT '{{0}}' AS entry, name, {COUNTS} FROM (SELECT trim(k) AS name, c FROM (SELECT {{1}} AS k, c FROM articles)) WHERE name <> '' GROUP BY 2"
_TOP = "SELECT * FROM ({}) ORDER BY 4 DESC, 3 DESC, lower(name), name LIMIT 5"


@query(
    f"{ARTICLES}, s AS ({_GROUP.format('top_subdomains', 'subdomain')}), r AS (SELECT *, row_number() OVER (ORDER BY citation_count DESC, paper_count DESC, lower(name), name) AS n, count(*) OVER () AS m FROM s) "
    "SELECT entry, CASE WHEN n > 5 THEN '其他领域 (' || (m - 5) || ' 类)' ELSE name END AS name, CAST(sum(paper_count) AS BIGINT) AS paper_count, CAST(sum(citation_count) AS BIGINT) AS citation_count FROM r GROUP BY 1, 2 "
    f"UNION ALL {_GROUP.format('classification_sources', 'CASE WHEN trim(source) = chr(39) THEN source WHEN trim(source) = repeat(chr(32), 0) THEN $$unknown$$ ELSE trim(source) END')} "
    f"UNION ALL ({_TOP.format(_GROUP.format('top_authors_by_citations', 'unnest(list_distinct(authors))'))}) UNION ALL ({_TOP.format(_GROUP.format('top_institutions_by_citations', 'unnest(list_distinct(institutions))'))}) UNION ALL ({_TOP.format(_GROUP.format('top_journals_by_citations', 'journal'))})"
)
def corpus_lists(spark, sf_dir):
    return summaries.corpus_lists(star.articles(spark, sf_dir), 5)


@query(f"{ARTICLES} SELECT kind, name, CAST(sum(c) AS BIGINT) AS citation_count FROM (SELECT 'author' AS kind, unnest(authors) AS name, c FROM articles UNION ALL SELECT 'institution', unnest(institutions), c FROM articles) GROUP BY 1, 2")
def citation_rankings(spark, sf_dir):
    return summaries.citation_rankings(star.articles(spark, sf_dir))


_SCORED = f"{POOL}, v AS (SELECT *, (length(title) % 10) / 10.0::DOUBLE AS r, (SELECT coalesce(max(citation_count), 0) FROM pool) AS most FROM pool)"


def _scored(spark, sf_dir) -> DataFrame:
    pool = refs_.pool(refs_.capped(star.references(spark, sf_dir), 5, 20000)).withColumn("relevance_score", F.length("title") % 10 / 10)
    return refs_.scored(pool, AS_OF)


@query(f"{_SCORED} SELECT count(*) AS total_references, count(*) FILTER (WHERE r >= 0.5) AS relevant_references, 0::BIGINT AS downloaded_references, 0.5::DOUBLE AS relevance_threshold, 'unmapped=' || count(*) AS journal_tiers FROM v")
def pool_summary(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumns({"pdf_status": F.lit("unchecked"), "local_pdf_path": F.lit("")})
    return summaries.pool_summary(rows, 0.5)


@query(f"{_SCORED}, o AS (SELECT *, {REF_VALUE} AS value FROM v) SELECT row_number() OVER (ORDER BY value DESC, r DESC, lower(title), ref_key) AS place, ref_key FROM o QUALIFY place <= 50")
def best_of_pool(spark, sf_dir):
    rows = summaries.ordered_pool(_scored(spark, sf_dir)).limit(50)
    w = Window.orderBy(F.desc("value_score"), F.desc("relevance_score"), F.lower("title"), "ref_key")
    return rows.select(F.row_number().over(w).cast("long").alias("place"), "ref_key")


@query(f"{REFS}, e AS (SELECT ref_key, source_title, min(o) AS o FROM keyed WHERE ref_key <> '' GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY ref_key ORDER BY o) AS n FROM e) SELECT ref_key, string_agg(source_title, ' | ' ORDER BY n) AS cited_by_source_papers FROM f WHERE n <= 5 GROUP BY 1")
def citing_titles(spark, sf_dir):
    return summaries.citing_titles(star.references(spark, sf_dir))


@query(f"{VALUED}, s AS (SELECT * FROM ranked WHERE why = 'eligible' ORDER BY rank LIMIT 10) SELECT (SELECT count(*) FROM ranked) AS total_candidates, (SELECT count(*) FROM ranked WHERE why = 'eligible') AS eligible_candidates, (SELECT count(*) FROM s) AS selected_for_download, (SELECT count(*) FROM s WHERE pdf_status = 'complete') AS completed_pdfs")
def download_summary(spark, sf_dir):
    ranked = ranking.rank_for_download(star.articles(spark, sf_dir), AS_OF, 0.5, True, TIERS)
    return summaries.download_summary(ranked, ranking.select_papers(ranked, 10))


def _status() -> Column:
    return F.get(F.array(F.lit("downloaded"), F.lit("skipped_existing"), F.lit("failed")), (F.col("_ord") % 3).cast("int"))


_EXPORTED = "doi <> '' AND pdf_status = 'complete' AND ord % 3 < 2"


@query(f"{ARTICLES} SELECT count(*) AS total_records, count(*) FILTER (WHERE {_EXPORTED}) AS exported_records, count(*) FILTER (WHERE NOT ({_EXPORTED})) AS skipped_records FROM articles")
def ris_summary(spark, sf_dir):
    return summaries.ris_summary(star.articles(spark, sf_dir).withColumn("download_status", _status()))


@query(f"{REFS} SELECT (SELECT count(*) FROM orders) AS total_source_articles, count(*) AS total_references, count(*) FILTER (WHERE relevance_score >= 0.12) AS exported_records, count(*) FILTER (WHERE relevance_score < 0.12) AS skipped_records FROM refs")
def ris_reference_summary(spark, sf_dir):
    refs = star.references(spark, sf_dir)
    return summaries.ris_reference_summary(star.articles(spark, sf_dir), refs, refs.where(F.col("relevance_score") >= summaries.percent_to_threshold(12)))


_ROW = f"CASE WHEN {REVIEW} THEN 'review_entry' WHEN TRY_CAST(year AS INTEGER) >= {AS_OF - 3} THEN 'recent_high_potential' WHEN c >= 100 THEN 'classic' ELSE 'important' END"
_PATH = "CASE WHEN ord % 11 = 0 THEN '/pdf/' || ord ELSE '' END"


@query(
    f"{VALUED}, el AS (SELECT ord, row_number() OVER (ORDER BY rank) AS p FROM ranked WHERE why = 'eligible') SELECT rank, coalesce(p <= 10, false) AS selected_for_download, why = 'eligible' AS eligible, why AS eligibility_reason, {_ROW} AS recommendation_type, title, doi, journal, tier AS journal_tier, year, subdomain, "
    f"article_type, c AS citation_count, '' AS citation_source, value AS research_value_score, '' AS pdf_url, {_PATH} AS local_pdf_path, '' AS download_status, pdf_status, '' AS error FROM ranked LEFT JOIN el USING (ord)"
)
def ranking_rows(spark, sf_dir):
    empty = {c: F.lit(None).cast("string") for c in ("citation_source", "pdf_url", "download_status", "error")}
    ranked = ranking.rank_for_download(star.articles(spark, sf_dir).withColumns(empty), AS_OF, 0.5, True, TIERS)
    return summaries.ranking_rows(ranked, ranking.select_papers(ranked, 10), AS_OF).drop("reason")


_DOWN = f"{ARTICLES}, d AS (SELECT * FROM articles WHERE pdf_status = 'complete'), most AS (SELECT coalesce(max(c), 0) AS most FROM d), "


def _down_sql() -> str:
    from .catalogue import value_sql

    return _DOWN + f"v AS (SELECT *, {value_sql('most')} AS value FROM d, most), g AS (SELECT *, count(*) OVER w AS n, sum(c) OVER w AS t, row_number() OVER (PARTITION BY subdomain ORDER BY value DESC, c DESC, lower(title), ord) AS place FROM v WINDOW w AS (PARTITION BY subdomain)), h AS (SELECT *, dense_rank() OVER (ORDER BY n DESC, t DESC, subdomain) AS domain_rank FROM g)"


@query(_down_sql() + " SELECT subdomain, place, title, value AS research_value_score FROM h WHERE place <= 4 ORDER BY domain_rank, place LIMIT 15")
def top_downloaded(spark, sf_dir):
    return summaries.top_downloaded(star.articles(spark, sf_dir), AS_OF, 15, 4, TIERS).select("subdomain", F.col("place").cast("long").alias("place"), "title", "research_value_score")


@query(_down_sql() + ", s AS (SELECT * FROM h WHERE place <= 4 ORDER BY domain_rank, place LIMIT 15) SELECT printf('domain_%03d', row_number() OVER (ORDER BY subdomain)) AS domain_id, subdomain AS domain_name, count(*) AS selected_paper_count, CAST(sum(c) AS BIGINT) AS citation_count FROM s GROUP BY subdomain")
def domain_packages(spark, sf_dir):
    return summaries.packages(summaries.top_downloaded(star.articles(spark, sf_dir), AS_OF, 15, 4, TIERS))


def _entries(spark, sf_dir) -> DataFrame:
    empty = {c: F.lit("") for c in ("classification_taxonomy", "classification_source_label", "citation_source")} | {"authoritative_topics": F.array().cast("array<string>")}
    rows = cut(star.articles(spark, sf_dir).withColumns(empty), "articles")
    return summaries.paper_entries(ranking.domain_papers(rows, ranking.select_domains(rows, 3), AS_OF, 5, TIERS))


_PICKED = f"{ARTICLES}, d AS (SELECT subdomain FROM articles GROUP BY 1 ORDER BY count(*) DESC, sum(c) DESC, 1 LIMIT 3), m AS (SELECT *, max(c) OVER (PARTITION BY subdomain) AS most FROM articles WHERE subdomain IN (SELECT subdomain FROM d)), "


def _picked_sql() -> str:
    from .catalogue import value_sql

    return _PICKED + f"v AS (SELECT *, {value_sql('most')} AS value FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY subdomain ORDER BY value DESC, c DESC, lower(title), ord) AS place FROM v)"


@query(_picked_sql() + f" SELECT printf('paper_%03d', place) AS paper_id, title, doi, year, publish_date, array_to_string(authors, '|') AS authors, subdomain AS domain, source AS classification_source, c AS citation_count, {_PATH} AS local_pdf_path, pdf_status, value AS research_value_score FROM p WHERE place <= 5")
def paper_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("paper_id", "title", "doi", "year", "publish_date", F.array_join("authors", "|").alias("authors"), "domain", "classification_source", "citation_count", "local_pdf_path", "pdf_status", "research_value_score")


@query(_picked_sql() + " SELECT subdomain AS domain, printf('paper_%03d', place) AS paper_id, title, len(authors) AS n_authors, c AS citation_count, 19 AS n_fields FROM p WHERE place <= 5")
def paper_payloads(spark, sf_dir):
    value = F.parse_json("payload")
    rows = summaries.payload(_entries(spark, sf_dir))
    return rows.select("domain", "paper_id", F.try_variant_get(value, "$.title", "string").alias("title"), F.size(F.try_variant_get(value, "$.authors", "array<string>")).cast("long").alias("n_authors"), F.try_variant_get(value, "$.citation_count", "int").alias("citation_count"), F.size(F.json_object_keys("payload")).alias("n_fields"))


_REC = f"{VALUED}, rec AS (SELECT *, {_ROW} AS kind FROM ranked WHERE rank <= 40)"


@query(f"{_REC}, l AS (SELECT title, rank, CASE kind WHEN 'review_entry' THEN 0 WHEN 'classic' THEN 1 WHEN 'recent_high_potential' THEN 2 END AS list, row_number() OVER (PARTITION BY kind ORDER BY rank) AS nth FROM rec), f AS (SELECT title, min((list, rank)) AS o FROM l WHERE list IS NOT NULL AND nth <= 12 GROUP BY 1) SELECT row_number() OVER (ORDER BY o) AS place, title FROM f QUALIFY place <= 12")
def recommended_reading(spark, sf_dir):
    rows = ranking.recommendations(star.articles(spark, sf_dir), AS_OF, 40, TIERS)
    return reports.recommended_reading(rows).select(F.col("place").cast("long").alias("place"), "title")


@query(f"{ARTICLES}, f AS (SELECT subdomain, ord, title, doi, row_number() OVER (PARTITION BY subdomain ORDER BY ord) AS n FROM articles) SELECT title, subdomain AS domain, doi FROM f WHERE n <= 3")
def source_paper_index(spark, sf_dir):
    return reports.source_paper_index(star.articles(spark, sf_dir).select(F.col("subdomain").alias("domain"), F.col("_ord").alias("ord"), "title", "doi"))


@query(f"SELECT token, count(*) AS count FROM (SELECT unnest(list_filter(regexp_extract_all(lower(p_name), '[a-z][a-z0-9+-]{{3,}}'), lambda t: t NOT IN ({', '.join(chr(39) + w + chr(39) for w in tx.TOPIC_STOPWORDS)}))) AS token FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def cross_domain_tokens(spark, sf_dir):
    return reports.cross_domain_tokens(star.table(spark, sf_dir, "part").select(F.col("p_name").alias("domain_name")))


@query(f"{_REC} SELECT 'review_entry_points' AS part, title FROM rec WHERE rank <= 20 AND kind = 'review_entry' UNION ALL SELECT 'classic_papers', title FROM rec WHERE rank <= 20 AND kind = 'classic' UNION ALL SELECT 'recent_high_potential_papers', title FROM rec WHERE rank <= 20 AND kind = 'recent_high_potential' UNION ALL SELECT 'topic_profiles', subdomain FROM (SELECT subdomain, count(*) AS n, sum(c) AS t FROM articles GROUP BY 1 ORDER BY 2 DESC, 3 DESC, lower(subdomain), subdomain LIMIT 20) UNION ALL SELECT 'year_trend', CASE WHEN year = '' THEN 'Unknown' ELSE year END FROM articles GROUP BY ALL")
def research_profile(spark, sf_dir):
    parts = summaries.research_profile(cut(star.articles(spark, sf_dir), "articles"), refs_.insights(star.references(spark, sf_dir)), AS_OF, 20, TIERS)
    names = {"review_entry_points": "title", "classic_papers": "title", "recent_high_potential_papers": "title", "topic_profiles": "subdomain", "year_trend": "year"}
    out = None
    for name, c in names.items():
        part = parts[name].select(F.lit(name).alias("part"), F.col(c).alias("title"))
        out = part if out is None else out.unionByName(part)
    return out


# --- clusters' labels --------------------------------------------------------------------------------------------------------

_CLUSTER_STOP = ", ".join(f"'{w}'" for w in classify.CLUSTER_STOPWORDS)
_LABEL_STOP = ", ".join(f"'{w}'" for w in classify.LABEL_STOPWORDS)
_CLUSTER_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9+-]{{3,}}'), lambda t: t NOT IN ({_CLUSTER_STOP}))"
_TITLED = "array_to_string(list_transform(regexp_extract_all(t, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 7 AS cluster, {_CLUSTER_TOKENS} AS ts FROM documents), t AS (SELECT cluster, doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS p FROM d),
k AS (SELECT cluster, token, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min((doc_id, p))) AS rank FROM t GROUP BY 1, 2), w AS (SELECT cluster, rank, trim(regexp_replace(token, '[^a-z0-9]+', '_', 'g'), '_') AS t FROM k WHERE rank <= 12),
u AS (SELECT cluster, t, min(rank) AS rank FROM w WHERE length(t) >= 4 AND t NOT IN ({_LABEL_STOP}) GROUP BY 1, 2), l AS (SELECT cluster, list({_TITLED} ORDER BY rank)[1:3] AS ws FROM u GROUP BY 1)
SELECT d.cluster, count(*) AS papers, CASE WHEN any_value(ws) IS NULL THEN 'Topic_Other' ELSE 'Topic_' || array_to_string(any_value(ws), '_') END AS label, round(least(0.95::DOUBLE, 0.68::DOUBLE + 0.05::DOUBLE * count(*)), 3) AS confidence FROM d LEFT JOIN l ON l.cluster = d.cluster GROUP BY 1""")
def cluster_labels(spark, sf_dir):
    rows = star.table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("cluster"), F.col("doc_id").alias("id"), "text")
    return classify.cluster_labels(rows).select("cluster", "papers", "label", "confidence")


# --- texts, statuses, orders -------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split(p_name, 'e'), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors, TRY_CAST(p_brand AS INTEGER) IS NULL AS no_int, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z]+'), lambda w: upper(w[1])), '') AS initials,
 p_brand AS last_segment, 'doi:10.1/' || p_partkey AS by_doi, 'url:http://x/' || p_partkey AS by_url, 'title:' || trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS by_title, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS clean FROM part""")
def text_functions(spark, sf_dir):
    c, none, key = F.col("p_name"), F.lit(""), F.col("p_partkey").cast("string")
    return star.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(tx.split_authors(F.replace(c, F.lit("e"), F.lit(";"))), "|").alias("authors"), tx.int_or_none(F.col("p_brand")).isNull().alias("no_int"), tx.journal_abbreviation(c).alias("initials"),
        tx.last_segment(F.concat("p_name", F.lit(" > "), "p_brand")).alias("last_segment"), tx.identity_key(F.concat(F.lit("https://doi.org/10.1/"), key), none, c).alias("by_doi"), tx.identity_key(none, F.concat(F.lit("HTTP://x/"), key), c).alias("by_url"), tx.identity_key(none, none, c).alias("by_title"), tx.clean_text(c).alias("clean"),
    )


@query("SELECT page_id, regexp_matches(lower(coalesce(url, '')), '\\.pdf$|/pdf|pdf=|type=printable') AS is_pdf, '{\"a\": ' || page_id || '}' AS body FROM pages")
def page_functions(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n{\"a\": "), F.col("page_id").cast("string"), F.lit("}\n```"))
    return star.table(spark, sf_dir, "pages").select("page_id", filters.looks_like_pdf_url(F.col("url")).alias("is_pdf"), tx.strip_code_fence(fenced).alias("body"))


_BIO = "regexp_matches(lower(coalesce(text, '')), '" + "|".join(filters.BIOMEDICAL) + "')"


@query(f"SELECT lang, count(*) FILTER (WHERE {_BIO}) AS biomedical, count(*) AS n FROM documents GROUP BY 1")
def biomedical_documents(spark, sf_dir):
    return star.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(filters.looks_biomedical(F.col("text"))).alias("biomedical"), F.count("*").alias("n"))


@query(f"{ARTICLES} SELECT ord, doi <> '' AND journal <> '' AND len(authors) > 0 AND citation_count IS NOT NULL AS sufficient, {_EXPORTED} AS exportable FROM articles")
def article_flags(spark, sf_dir):
    rows = star.articles(spark, sf_dir).withColumns({"download_status": _status(), "abstract": F.lit("x"), "institutions": F.array(F.lit("x"))})
    return rows.select(F.col("_ord").alias("ord"), filters.sufficient_metadata().alias("sufficient"), filters.ris_exportable().alias("exportable"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'low' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'medium' WHEN doc_id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM labels")
def downgraded_confidence(spark, sf_dir):
    k = F.col("doc_id")
    level = F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3).cast("int"))
    return star.table(spark, sf_dir, "labels").select("doc_id", scoring.downgraded(F.when(k % 2 == 0, "high").otherwise("medium"), level).alias("confidence"))


@query("SELECT item_id AS id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(source), lower(label) ORDER BY pos) AS n FROM (SELECT item_id, 0 AS pos, 'openalex' AS source, 'A' || item_id % 3 AS label FROM benchmark UNION ALL SELECT item_id, 1, 'OpenAlex', 'a' || item_id % 2 FROM benchmark)) WHERE n = 1")
def merged_topics(spark, sf_dir):
    b = star.table(spark, sf_dir, "benchmark")
    topic = lambda pos, source, letter, n: b.select(F.col("item_id").alias("id"), F.lit(pos).alias("pos"), F.lit(source).alias("source"), F.lit("t").alias("taxonomy"), F.concat(F.lit(letter), (F.col("item_id") % n).cast("string")).alias("label"))
    return enrich.merge_topics(topic(0, "openalex", "A", 3).unionByName(topic(1, "OpenAlex", "a", 2))).select("id", "source", "label")


@query("SELECT doc_id, CASE WHEN coalesce(n_chars, 0) * 100 < 200000 THEN 'too_small' WHEN doc_id % 5 = 0 THEN 'not_pdf' WHEN regexp_matches(lower(text), 'purchase access|access denied') THEN 'paywalled_or_incomplete' WHEN NOT regexp_matches(lower(text), 'abstract|references') THEN 'missing_paper_markers' ELSE 'complete' END AS status FROM documents WHERE text IS NOT NULL")
def pdf_states(spark, sf_dir):
    head = F.when(F.col("doc_id") % 5 == 0, "<html>").otherwise("%PDF-1.4 ")
    rows = star.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.coalesce("n_chars", F.lit(0)) * 100).alias("length"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    return rows.select("doc_id", pdf.state(F.col("content"), F.col("length"), ("purchase access", "access denied")).alias("status"))


@query(f"{ARTICLES} SELECT ord, '（' || CASE WHEN year = '' THEN '未知年份' ELSE year END || '，' || CASE WHEN journal = '' THEN '未知期刊' ELSE upper(journal[1]) END || '）' || title || '（' || CASE WHEN len(authors) = 0 THEN '未知作者' ELSE authors[1] END || '，' || CASE WHEN len(institutions) = 0 THEN '未知机构' ELSE institutions[1] END || '）.pdf' AS name FROM articles")
def pdf_names(spark, sf_dir):
    return star.articles(spark, sf_dir).select(F.col("_ord").alias("ord"), pdf.file_name().alias("name"))


@query(f"{ARTICLES} SELECT ord, CASE WHEN c < 50 THEN 'below_min_citations' ELSE 'metadata_only' END AS status FROM articles")
def processing_gate(spark, sf_dir):
    kept = filters.ArticleFilter(min_citations=50).column()
    return star.articles(spark, sf_dir).select(F.col("_ord").alias("ord"), F.when(~kept, "below_min_citations").otherwise(pdf.gate(metadata_only=True)).alias("status"))


def _listing(n: int) -> Column:
    return F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda p: F.concat(F.lit("https://x/list?page="), p.cast("string")))


@query("SELECT r_regionkey AS id, 5 - g AS place, 'https://x/list?page=' || g AS url FROM region, range(1, 6) t(g)")
def listing_urls(spark, sf_dir):
    return star.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.posexplode(_listing(5)).alias("place", "url"))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def pending_events(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events")
    return monitor.pending(rows, rows.where("event_type = 'click'"), "event_id").select("event_id")


@query("SELECT 'd' || doc_id AS domain, '# ' || 'd' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 's' ELSE '' END AS head, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 > 0 THEN '- g' || doc_id ELSE '- Not enough evidence in the prepared inputs.' END AS gaps, 'Confidence: low' AS last FROM labels")
def domain_reports(spark, sf_dir):
    rows = _syntheses(spark, sf_dir).withColumn("s", validation.repaired_synthesis(F.col("answer"), F.col("domain")))
    lines = F.split(reports.domain_report(F.col("s")), "\n")
    gaps = F.get(F.split(reports.domain_report(F.col("s")), "## Research Gaps\n\n"), F.lit(1))
    return rows.select("domain", F.array_join(F.slice(lines, 1, 3), "\n").alias("head"), F.get(F.split(gaps, "\n"), F.lit(0)).alias("gaps"), F.get(lines, F.size(lines) - 2).alias("last"))


@query(f"{ARTICLES} SELECT subdomain || ' (' || count(*) || ' papers; ' || sum(c)::BIGINT || ' citations)' AS line FROM articles GROUP BY subdomain")
def count_lines(spark, sf_dir):
    rows = stats.group_counts(star.articles(spark, sf_dir), F.col("subdomain"), "subdomain")
    return rows.select(reports.count_line(F.col("subdomain"), F.col("paper_count"), F.col("citation_count")).alias("line"))


@query(f"{_SCORED}, o AS (SELECT *, {REF_VALUE} AS value, citation_count % 2 = 0 AS done FROM v), g AS (SELECT *, row_number() OVER w AS place, coalesce(sum((coalesce(done, false))::INT) OVER (ORDER BY value DESC, r DESC, lower(title), ref_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE r >= 0.3 AND value >= 0.2 AND doi <> '' WINDOW w AS (ORDER BY value DESC, r DESC, lower(title), ref_key)) SELECT ref_key FROM g WHERE before < 15")
def downloadable_references(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("completed", F.coalesce(F.col("citation_count") % 2 == 0, F.lit(False)))
    return refs_.downloadable(rows, 0.3, 0.2, 15).select("ref_key")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '{\"a\": 1}' ELSE 'x' || conv_id END AS answer FROM conversations WHERE text IS NULL OR text <> ''")
def model_answers(spark, sf_dir):
    """The text of answers of both protocols, and of a field that lies deep in one."""
    text = F.coalesce("text", F.lit(""))
    outputs = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content"))).alias("output")))
    fenced = F.lit('{"choices": [{"message": {"content": "```json\\n{\\"a\\": 1}\\n```"}}]}')
    deep = F.format_string('{"a": [{"b": 1}, {"c": {"said": "x%s"}}]}', F.col("conv_id").cast("string"))
    t = F.col("turn") % 3
    rows = star.table(spark, sf_dir, "conversations").where("text is null or text <> ''")
    return rows.select("conv_id", "turn", F.when(t == 0, text).when(t == 1, runs.answer_text(fenced)).otherwise(tx.first_field(deep, "said")).alias("answer"))


@query("SELECT page_id, page_id % 4 < 3 AS is_next, page_id % 2 = 0 AS is_listing FROM pages")
def page_links(spark, sf_dir):
    k = F.col("page_id")
    anchors = F.array(F.lit('<a rel="nofollow next" href="x">2</a>'), F.lit("<a href='y'> Next </a>"), F.lit('<a aria-label="Go to next page" href="z">&gt;</a>'), F.lit('<a href="next">previous</a>'))
    urls = F.array(F.concat(F.lit("https://x.org/j/research-articles/?page="), k.cast("string")), F.lit("https://x.org/j/research-articles"))
    return star.table(spark, sf_dir, "pages").select("page_id", tx.is_next_link(F.get(anchors, (k % 4).cast("int"))).alias("is_next"), tx.is_listing_url(F.get(urls, (k % 2).cast("int")), "x.org", "/j/research-articles").alias("is_listing"))


@query(f"{ARTICLES} SELECT ord, title, doi, journal, publish_date, subdomain, coalesce(citation_count, -1) AS citation_count FROM articles")
def manifest_roundtrip(spark, sf_dir):
    """Articles as a manifest's JSON, read again with the defaults of absent fields."""
    rows = normalise_articles(star.articles(spark, sf_dir))
    texts = rows.select("_ord", F.to_json(F.struct(*[f.name for f in ARTICLE.fields])).alias("j"))
    back = normalise_articles(texts.select("_ord", F.from_json("j", ARTICLE).alias("a")).select("_ord", "a.*"))
    return back.select(F.col("_ord").alias("ord"), "title", "doi", "journal", "publish_date", "subdomain", F.coalesce("citation_count", F.lit(-1)).alias("citation_count"))


@query()
def evidence_bundles(spark, sf_dir):
    rows = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(tx.sentences(F.col("text")), F.lit(0)).alias("abstract"), "text")
    return evidence.evidence_bundles(rows, 4).select("id", "total_chunks", F.size("selected_chunks").alias("n_selected"), "coverage_status", F.array_join("missing_reasons", ",").alias("missing_reasons"))
