"""The registered queries, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring, text as tx
from ..operators import classify, enrich, evidence, filters, linkage, monitor, ranking, references as refs_, stats
from ..sources import pages as pages_, sinks, star
from ..tables import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The year that ages are counted from.
AS_OF = 2000
#: Tiers for the stand-in journals; some names are parts of others.
TIERS = (("auto", "top_general", 0.9), ("machinery", "top_field", 0.8), ("building supplies", "field_journal", 0.7))
RULES = (("motion", ("tion", "ing")), ("thing", ("the", "of")), ("deed", ("ed", "and the")))

ARTICLES = """WITH line AS (SELECT l_orderkey, l_linenumber, s_name, n_name, l_quantity FROM lineitem LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey),
au AS (SELECT l_orderkey, list(s_name ORDER BY n, s_name) AS authors FROM (SELECT l_orderkey, s_name, min(l_linenumber) AS n FROM line WHERE s_name IS NOT NULL GROUP BY ALL) GROUP BY l_orderkey),
inst AS (SELECT l_orderkey, list(n_name ORDER BY n, n_name) AS institutions FROM (SELECT l_orderkey, n_name, min(l_linenumber) AS n FROM line WHERE n_name IS NOT NULL GROUP BY ALL) GROUP BY l_orderkey),
cit AS (SELECT l_orderkey, CAST(floor(sum(l_quantity)) AS INTEGER) AS citation_count FROM lineitem GROUP BY l_orderkey),
articles AS (SELECT CAST(o_orderkey AS BIGINT) AS ord, 'Paper ' || o_orderkey || CASE WHEN o_orderkey % 13 = 0 THEN ' a review' ELSE '' END AS title, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '10.1000/' || o_orderkey END AS doi,
  coalesce(c_mktsegment, '') AS journal, o_orderstatus AS article_type, strftime(o_orderdate, '%Y-%m-%d') AS publish_date, o_orderpriority AS subdomain, coalesce(authors, []) AS authors, coalesce(institutions, []) AS institutions, citation_count,
  coalesce(citation_count, 0) AS c, (o_orderkey % 100) / 100.0 AS confidence, ['openalex', 'crossref', 'pubmed_mesh', 'local_rule', 'none', ''][o_orderkey % 6 + 1] AS source, CASE WHEN o_orderkey % 11 = 0 THEN 'complete' ELSE 'unchecked' END AS pdf_status,
  regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '(19|20)[0-9]{2}', 0) AS year
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN au ON au.l_orderkey = o_orderkey LEFT JOIN inst ON inst.l_orderkey = o_orderkey LEFT JOIN cit ON cit.l_orderkey = o_orderkey)"""
COUNTS = "count(*) AS paper_count, CAST(sum(c) AS BIGINT) AS citation_count"
TIER_SQL = "CASE WHEN lower(journal) = 'machinery' THEN {1} WHEN lower(journal) <> '' AND (contains(lower(journal), 'auto') OR contains('auto', lower(journal))) THEN {0} WHEN lower(journal) <> '' AND (contains(lower(journal), 'machinery') OR contains('machinery', lower(journal))) THEN {1} WHEN lower(journal) <> '' AND (contains(lower(journal), 'building supplies') OR contains('building supplies', lower(journal))) THEN {2} ELSE {3} END"
TIER = TIER_SQL.format("'top_general'", "'top_field'", "'field_journal'", "'unmapped'")
TIER_SCORE = TIER_SQL.format("0.9::DOUBLE", "0.8::DOUBLE", "0.7::DOUBLE", "0.45::DOUBLE")
REVIEW = "regexp_matches(lower(article_type || ' ' || title), 'review|survey')"
AGE = f"coalesce(greatest(0.2::DOUBLE, 1.0 - least(greatest({AS_OF} - TRY_CAST(year AS INTEGER), 0), 20) / 20.0::DOUBLE), 0.45::DOUBLE)"
COMPLETE = "round((1 + (doi <> '')::INT + (journal <> '')::INT + (publish_date <> '')::INT + (len(authors) > 0)::INT + (len(institutions) > 0)::INT + 0 + (citation_count IS NOT NULL)::INT + (subdomain <> '')::INT) / 9.0::DOUBLE, 3)"


def value_sql(most: str) -> str:
    cite = f"CASE WHEN c > 0 AND {most} > 0 THEN least(1.0::DOUBLE, ln(1 + c::DOUBLE) / ln(1 + {most}::DOUBLE)) ELSE 0.0::DOUBLE END"
    return f"round(least(1.0::DOUBLE, 0.30::DOUBLE * {cite} + 0.20::DOUBLE * {TIER_SCORE} + 0.18::DOUBLE * {AGE} + 0.12::DOUBLE * (CASE WHEN {REVIEW} THEN 0.75 ELSE 0.45 END)::DOUBLE + 0.10::DOUBLE * confidence::DOUBLE + 0.10::DOUBLE * {COMPLETE}), 3)"


VALUED = ARTICLES + f", most AS (SELECT coalesce(max(c), 0) AS most FROM articles), valued AS (SELECT *, {value_sql('most')} AS value, {TIER} AS tier FROM articles, most), ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, c DESC, lower(title), ord) AS rank, CASE WHEN doi = '' THEN 'missing_doi' WHEN value < 0.5 THEN 'below_min_value_score' WHEN pdf_status = 'complete' THEN 'already_complete' ELSE 'eligible' END AS why FROM valued)"
REFS = """WITH refs AS (SELECT CAST(l_orderkey AS BIGINT) AS ord, l_linenumber::BIGINT * 10000000 + p_partkey AS pos, 'Paper ' || l_orderkey AS source_title, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '10.2000/' || p_partkey END AS doi, p_brand AS journal,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE (1990 + p_partkey % 30) || '-01' END AS publish_date, CASE WHEN p_partkey % 17 <> 0 THEN CAST(floor(p_retailprice) AS INTEGER) END AS citation_count, (p_partkey % 10) / 10.0::DOUBLE AS relevance_score, (p_partkey % 7) / 7.0::DOUBLE AS value_score FROM lineitem JOIN part ON l_partkey = p_partkey),
keyed AS (SELECT *, CASE WHEN trim(doi) <> '' THEN lower(trim(doi)) ELSE lower(trim(title)) END AS ref_key, (ord, pos) AS o FROM refs)"""
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9+-]{{{1},}}'), lambda t: t NOT IN ({2}))"
quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1␞', 'g'), '␞'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
DOCS = f"docs AS (SELECT doc_id AS ord, coalesce(text, '') AS abstract, coalesce({SENTENCES.format('coalesce(text, chr(32))')}[1], '') AS title, source AS journal, lang AS subdomain FROM documents)"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _written(articles: DataFrame) -> DataFrame:
    """The view of several joins as a table, for queries that read it more than once."""
    return cut(articles, "articles")


def counts_query(name: str, key: str, sql_key: str, many: bool = False, most: int | None = None) -> None:
    """AGG-01 by one key: as a DataFrame and as SQL."""
    column = {"year": stats.year_or_unknown, "team": stats.team_label, "citation_bucket": stats.citation_bucket, "collaboration_type": stats.collaboration_type, "classification_source": stats.source_or_unknown}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = column[key]() if key in column else F.col(f"{key}s" if many else key)
        rows = stats.group_counts(star.articles(spark, sf_dir), k, key, many)
        return stats.ranked(rows, key, most) if most else rows

    source = f"(SELECT unnest(list_distinct({sql_key})) AS k, c FROM articles)" if many else f"(SELECT {sql_key} AS k, c FROM articles)"
    sql = f"{ARTICLES} SELECT trim(k) AS {key}, {COUNTS} FROM {source} WHERE trim(k) <> '' GROUP BY 1"
    QUERIES[name] = run
    ORACLES[name] = sql + (f" ORDER BY 3 DESC, 2 DESC, lower({key}), {key} LIMIT {most}" if most else "")


TEAM = "CASE WHEN len(institutions) > 0 THEN institutions[1] WHEN len(authors) >= 2 THEN authors[1] || ' + ' || authors[2] WHEN len(authors) = 1 THEN authors[1] ELSE 'Unknown' END"
COLLAB = "CASE WHEN len(authors) <= 1 THEN 'single_author' WHEN len(authors) <= 3 THEN 'small_team' WHEN len(authors) <= 10 THEN 'medium_team' ELSE 'large_team' END || CASE WHEN len(institutions) <= 1 THEN '_single_institution' ELSE '_multi_institution' END"
counts_query("year_trend", "year", "CASE WHEN year = '' THEN 'Unknown' ELSE year END")
counts_query("source_stats", "classification_source", "CASE WHEN trim(source) = '' THEN 'unknown' ELSE trim(source) END")
counts_query("article_type_stats", "article_type", "article_type")
counts_query("journal_stats", "journal", "journal", most=20)
counts_query("author_stats", "author", "authors", many=True, most=20)
counts_query("institution_stats", "institution", "institutions", many=True, most=20)
counts_query("team_stats", "team", TEAM, most=20)
counts_query("citation_buckets", "citation_bucket", "CASE WHEN c <= 0 THEN '0' WHEN c < 10 THEN '1-9' WHEN c < 50 THEN '10-49' WHEN c < 100 THEN '50-99' ELSE '100+' END")
counts_query("collaboration", "collaboration_type", COLLAB)


@query(f"{ARTICLES} SELECT subdomain, {COUNTS}, " + ", ".join(f"count(*) FILTER (WHERE source = '{s}') AS {s}_count" for s in ("pubmed_mesh", "openalex", "crossref", "local_rule")) + ", count(*) FILTER (WHERE source IN ('none', '')) AS unclassified_count FROM articles GROUP BY 1")
def subdomain_stats(spark, sf_dir):
    return stats.subdomain_stats(star.articles(spark, sf_dir))


@query(f"{ARTICLES} SELECT CASE WHEN year = '' THEN 'Unknown' ELSE year END AS year, subdomain, {COUNTS} FROM articles GROUP BY 1, 2")
def subdomain_year_trend(spark, sf_dir):
    return stats.subdomain_year(star.articles(spark, sf_dir))


PROFILES = f"""{ARTICLES}, y AS (SELECT subdomain, TRY_CAST(year AS INTEGER) AS y FROM articles), e AS (SELECT subdomain, min(y) AS a, max(y) AS z FROM y GROUP BY 1),
tr AS (SELECT y.subdomain, CASE WHEN max(z) IS NULL THEN 'unknown' WHEN max(a) = max(z) THEN 'new' WHEN count(*) FILTER (WHERE y >= z - 1) > count(*) FILTER (WHERE y <= a + 1) THEN 'rising' WHEN count(*) FILTER (WHERE y >= z - 1) < count(*) FILTER (WHERE y <= a + 1) THEN 'declining' ELSE 'stable' END AS trend, CASE WHEN max(z) IS NULL THEN 'Unknown' ELSE max(a) || '-' || max(z) END AS year_span FROM y JOIN e ON y.subdomain = e.subdomain GROUP BY 1),
tok AS (SELECT subdomain, ord, unnest({TOKENS.format('title', 2, quoted(tx.TOPIC_STOPWORDS))}) AS token, generate_subscripts({TOKENS.format('title', 2, quoted(tx.TOPIC_STOPWORDS))}, 1) AS p, 1 AS w FROM articles UNION ALL
 SELECT subdomain, -1, unnest({TOKENS.format("replace(replace(subdomain, 'Topic_', ''), '_', ' ')", 2, quoted(tx.TOPIC_STOPWORDS))}), generate_subscripts({TOKENS.format("replace(replace(subdomain, 'Topic_', ''), '_', ' ')", 2, quoted(tx.TOPIC_STOPWORDS))}, 1), 3 FROM (SELECT DISTINCT subdomain FROM articles)),
kw AS (SELECT subdomain, token, row_number() OVER (PARTITION BY subdomain ORDER BY sum(w) DESC, min((ord, p))) AS r FROM tok GROUP BY 1, 2),
kws AS (SELECT subdomain, string_agg(token, '; ' ORDER BY r) AS representative_keywords FROM kw WHERE r <= 8 GROUP BY 1),
profiles AS (SELECT a.subdomain, count(*) AS paper_count, CAST(sum(c) AS BIGINT) AS citation_count, round(avg(c), 2) AS average_citations, any_value(coalesce(representative_keywords, '')) AS representative_keywords, array_to_string(list(title ORDER BY ord)[1:3], ' | ') AS representative_papers, array_to_string(list(title ORDER BY c DESC, ord)[1:3], ' | ') AS top_cited_papers, any_value(year_span) AS year_span, any_value(trend) AS trend
 FROM articles a JOIN tr ON a.subdomain = tr.subdomain LEFT JOIN kws ON kws.subdomain = a.subdomain GROUP BY 1)"""


@query(f"{PROFILES} SELECT subdomain, paper_count, citation_count, average_citations, representative_keywords, representative_papers, top_cited_papers, year_span, trend FROM profiles")
def topic_profiles(spark, sf_dir):
    return stats.topic_profiles(_written(star.articles(spark, sf_dir)))


#: Papers whose years lie the closer the later they are, so that topics grow.
GROWN = PROFILES.replace("FROM articles", "FROM grown").replace(ARTICLES, f"{ARTICLES}, grown AS (SELECT * REPLACE (CAST(1990 + floor(sqrt(ord % 100))::INT AS VARCHAR) AS year) FROM articles)")


@query(f"{GROWN} SELECT subdomain, paper_count, trend, year_span FROM profiles WHERE trend IN ('rising', 'new')")
def growing_topics(spark, sf_dir):
    rows = star.articles(spark, sf_dir).withColumn("publish_date", (1990 + F.floor(F.sqrt(F.col("_ord") % 100))).cast("string"))
    return stats.growing(stats.topic_profiles(_written(rows))).select("subdomain", "paper_count", "trend", "year_span")


@query(f"""{ARTICLES} SELECT count(*) AS total_papers, coalesce(min(nullif(year, '')), '') AS year_min, coalesce(max(nullif(year, '')), '') AS year_max, CAST(sum(c) AS BIGINT) AS total_citations, round(avg(c), 2) AS average_citations, round(median(c), 2) AS median_citations,
 round(avg((pdf_status = 'complete')::INT), 3) AS open_fulltext_coverage, count(*) FILTER (WHERE {REVIEW}) AS review_papers, count(*) FILTER (WHERE NOT regexp_matches(lower(article_type), 'review|editorial|comment|news|perspective')) AS research_papers,
 (SELECT count(DISTINCT u) FROM (SELECT unnest(authors) AS u FROM articles)) AS unique_authors, (SELECT count(DISTINCT u) FROM (SELECT unnest(institutions) AS u FROM articles)) AS unique_institutions FROM articles""")
def corpus_summary(spark, sf_dir):
    return stats.corpus_summary(_written(star.articles(spark, sf_dir)))


@query(f"{ARTICLES}, g AS (SELECT team AS team, {COUNTS}, row_number() OVER (ORDER BY sum(c) DESC, count(*) DESC, lower(team), team) AS r FROM (SELECT {TEAM} AS team, c FROM articles) GROUP BY 1), t AS (SELECT greatest(count(*) - 5, 0) AS n FROM g) SELECT CASE WHEN r > 5 THEN '其他领域 (' || n || ' 类)' ELSE team END AS team, CAST(sum(paper_count) AS BIGINT) AS paper_count, CAST(sum(citation_count) AS BIGINT) AS citation_count FROM g, t GROUP BY 1")
def fold_tail_other(spark, sf_dir):
    return stats.fold_tail(stats.group_counts(star.articles(spark, sf_dir), stats.team_label(), "team"), "team", 5, ["paper_count", "citation_count"])


@query(f"{ARTICLES} SELECT kind, name, count(*) AS count FROM (SELECT 'author' AS kind, unnest(authors) AS name FROM articles UNION ALL SELECT 'institution', unnest(institutions) FROM articles UNION ALL SELECT 'journal', journal FROM articles UNION ALL SELECT 'subdomain', subdomain FROM articles) WHERE name <> '' GROUP BY 1, 2")
def basic_stats_rankings(spark, sf_dir):
    return stats.basic_rankings(_written(star.articles(spark, sf_dir)))


@query(f"{ARTICLES} SELECT title, doi, journal, year, subdomain, article_type, c AS citation_count FROM articles ORDER BY c DESC, lower(title), ord LIMIT 20")
def top_papers(spark, sf_dir):
    rows = star.articles(spark, sf_dir).orderBy(F.desc(stats.cited()), F.lower("title"), "_ord").limit(20)
    return rows.select("title", "doi", "journal", tx.extract_year(F.col("publish_date")).alias("year"), "subdomain", "article_type", stats.cited().alias("citation_count"))


@query(f"{VALUED} SELECT rank, CASE WHEN {REVIEW} THEN 'review_entry' WHEN TRY_CAST(year AS INTEGER) >= {AS_OF - 3} THEN 'recent_high_potential' WHEN c >= 100 THEN 'classic' ELSE 'important' END AS recommendation_type, title, tier AS journal_tier, value AS research_value_score FROM ranked WHERE rank <= 20")
def paper_recommendations(spark, sf_dir):
    rows = ranking.recommendations(star.articles(spark, sf_dir), AS_OF, 20, TIERS)
    return rows.select(F.col("rank").cast("long").alias("rank"), "recommendation_type", "title", "journal_tier", "research_value_score")


@query(f"{VALUED} SELECT rank, title, value AS research_value_score, tier AS journal_tier, why AS eligibility_reason FROM ranked")
def pdf_ranking(spark, sf_dir):
    return ranking.rank_for_download(star.articles(spark, sf_dir), AS_OF, 0.5, True, TIERS).select("rank", "title", "research_value_score", "journal_tier", "eligibility_reason")


@query(f"{VALUED}, el AS (SELECT *, row_number() OVER (PARTITION BY subdomain ORDER BY rank) AS place FROM ranked WHERE why = 'eligible'), d AS (SELECT subdomain, row_number() OVER (ORDER BY count(*) DESC, sum(c) DESC, subdomain) AS domain_rank FROM el GROUP BY 1) SELECT el.subdomain, domain_rank, place, title FROM el JOIN d ON el.subdomain = d.subdomain WHERE domain_rank <= 3 AND place <= 5")
def select_per_domain(spark, sf_dir):
    ranked = ranking.rank_for_download(star.articles(spark, sf_dir), AS_OF, 0.5, True, TIERS)
    return ranking.select_papers(ranked, 3, 5).select("subdomain", F.col("domain_rank").cast("long").alias("domain_rank"), F.col("place").cast("long").alias("place"), "title")


@query(f"{VALUED} SELECT rank, title FROM ranked WHERE why = 'eligible' ORDER BY rank LIMIT 10")
def select_flat(spark, sf_dir):
    return ranking.select_papers(ranking.rank_for_download(star.articles(spark, sf_dir), AS_OF, 0.5, True, TIERS), 10).select("rank", "title")


@query(f"{ARTICLES} SELECT subdomain, {COUNTS} FROM articles GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 3")
def select_domains(spark, sf_dir):
    return ranking.select_domains(star.articles(spark, sf_dir), 3)


@query(f"{ARTICLES}, d AS (SELECT subdomain FROM articles GROUP BY 1 ORDER BY count(*) DESC, sum(c) DESC, 1 LIMIT 3), m AS (SELECT *, max(c) OVER (PARTITION BY subdomain) AS most FROM articles WHERE subdomain IN (SELECT subdomain FROM d)), v AS (SELECT *, {value_sql('most')} AS value FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY subdomain ORDER BY value DESC, c DESC, lower(title), ord) AS place FROM v) SELECT subdomain, printf('paper_%03d', place) AS paper_id, title, value AS research_value_score FROM p WHERE place <= 5")
def domain_papers_local_norm(spark, sf_dir):
    rows = _written(star.articles(spark, sf_dir))
    return ranking.domain_papers(rows, ranking.select_domains(rows, 3), AS_OF, 5, TIERS).select("subdomain", "paper_id", "title", "research_value_score")


@query(f"{ARTICLES} SELECT ord AS article_id, title FROM articles WHERE contains(lower(title || '  ' || journal || ' ' || article_type), 'paper') AND contains(lower(title || '  ' || journal || ' ' || article_type), 'review') AND (contains(lower(article_type), 'o') OR contains(lower(article_type), 'f')) AND c >= 20 AND TRY_CAST(year AS INTEGER) BETWEEN 1993 AND 1997")
def filter_articles(spark, sf_dir):
    f = filters.ArticleFilter(keywords=["Paper", "review"], article_types=["O", "F"], min_citations=20, from_year=1993, to_year=1997)
    return star.articles(spark, sf_dir).where(f.column()).select(F.col("_ord").alias("article_id"), "title")


@query(f"{ARTICLES} SELECT ord AS article_id FROM articles WHERE len(list_filter(authors, lambda a: contains(lower(a), '00001') OR contains(lower(a), '00022'))) > 0 AND len(list_filter(institutions, lambda a: contains(lower(a), 'a'))) > 0")
def filter_people(spark, sf_dir):
    f = filters.ArticleFilter(authors=["00001", "00022"], institutions=["A"])
    return star.articles(spark, sf_dir).where(f.column()).select(F.col("_ord").alias("article_id"))


@query(f"{ARTICLES} SELECT {REVIEW} AS is_review, NOT regexp_matches(lower(article_type), 'review|editorial|comment|news|perspective') AS is_research, count(*) AS n FROM articles GROUP BY 1, 2")
def review_vs_research(spark, sf_dir):
    kind, title = F.col("article_type"), F.col("title")
    return star.articles(spark, sf_dir).groupBy(scoring.is_review(kind, title).alias("is_review"), scoring.is_research(kind, title).alias("is_research")).agg(F.count("*").alias("n"))


@query(f"{ARTICLES} SELECT array_to_string(list_filter([CASE WHEN doi = '' THEN 'doi' END, CASE WHEN journal = '' THEN 'journal' END, CASE WHEN article_type = '' THEN 'article_type' END, CASE WHEN publish_date = '' THEN 'publish_date' END, 'abstract', CASE WHEN len(authors) = 0 THEN 'authors' END, CASE WHEN len(institutions) = 0 THEN 'institutions' END, CASE WHEN citation_count IS NULL THEN 'citation_count' END], lambda x: x IS NOT NULL), ',') AS missing, (doi = '' OR citation_count IS NULL) AS helps, count(*) AS n FROM articles GROUP BY 1, 2")
def missing_metadata(spark, sf_dir):
    rows = star.articles(spark, sf_dir)
    return rows.groupBy(F.array_join(filters.missing_fields(), ",").alias("missing"), filters.can_help(["doi", "citation_count"]).alias("helps")).agg(F.count("*").alias("n"))


POOL = f"""{REFS}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY pos) AS n FROM keyed) WHERE n <= 5), total AS (SELECT * FROM capped ORDER BY ord, pos LIMIT 20000),
pool AS (SELECT ref_key, coalesce(arg_min(title, o) FILTER (WHERE title <> ''), '') AS title, coalesce(arg_min(doi, o) FILTER (WHERE doi <> ''), '') AS doi, coalesce(arg_min(journal, o) FILTER (WHERE journal <> ''), '') AS journal, coalesce(arg_min(publish_date, o) FILTER (WHERE publish_date <> ''), '') AS publish_date, arg_min_null(citation_count, o) AS citation_count, CAST(count(DISTINCT source_title) AS INTEGER) AS source_article_count, CAST(0.0 AS DOUBLE) AS relevance_score FROM total WHERE ref_key <> '' GROUP BY 1)"""


def _pool(spark, sf_dir):
    return refs_.pool(refs_.capped(star.references(spark, sf_dir), 5, 20000))


@query(f"{POOL} SELECT ref_key, title, doi, journal, publish_date, coalesce(citation_count, -1) AS citation_count, source_article_count FROM pool")
def reference_pool(spark, sf_dir):
    citations = F.coalesce("citation_count", F.lit(-1)).alias("citation_count")
    return _pool(spark, sf_dir).select("ref_key", "title", "doi", "journal", "publish_date", citations, "source_article_count")


REF_VALUE = f"round(least(1.0::DOUBLE, 0.35::DOUBLE * r + 0.20::DOUBLE * (CASE WHEN coalesce(citation_count, 0) > 0 AND most > 0 THEN least(1.0::DOUBLE, ln(1 + citation_count::DOUBLE) / ln(1 + most::DOUBLE)) ELSE 0.0::DOUBLE END) + 0.15::DOUBLE * 0.45::DOUBLE + 0.10::DOUBLE * least(1.0::DOUBLE, source_article_count / 5.0::DOUBLE) + 0.10::DOUBLE * coalesce(greatest(0.2::DOUBLE, 1.0 - least(greatest({AS_OF} - TRY_CAST(nullif(regexp_extract(publish_date, '(19|20)[0-9]{{2}}', 0), '') AS INTEGER), 0), 20) / 20.0::DOUBLE), 0.45::DOUBLE) + 0.10::DOUBLE * (((title <> '')::INT + (doi <> '')::INT + (journal <> '')::INT + (publish_date <> '')::INT + (citation_count IS NOT NULL)::INT) / 7.0::DOUBLE)), 3)"


@query(f"{POOL}, v AS (SELECT *, (length(title) % 10) / 10.0::DOUBLE AS r, (SELECT coalesce(max(citation_count), 0) FROM pool) AS most FROM pool) SELECT ref_key, {REF_VALUE} AS value_score, 'unmapped' AS journal_tier FROM v")
def reference_value(spark, sf_dir):
    rows = _pool(spark, sf_dir).withColumn("relevance_score", F.length("title") % 10 / 10)
    return refs_.scored(rows, AS_OF).select("ref_key", "value_score", "journal_tier")


@query(f"{POOL}, v AS (SELECT journal, ref_key, row_number() OVER (PARTITION BY journal ORDER BY coalesce(citation_count, 0) DESC, ref_key) AS place FROM pool) SELECT journal, ref_key, place FROM v WHERE place <= 3")
def reference_top_by_journal(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("journal").orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), "ref_key")
    return _pool(spark, sf_dir).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("journal", "ref_key", "place")


@query(f"{REFS} SELECT ref_key, arg_min(title, o) AS title, max(coalesce(citation_count, 0)) AS citation_count, max(relevance_score) AS relevance_score, max(value_score) AS value_score FROM keyed WHERE ref_key <> '' GROUP BY 1 ORDER BY 5 DESC, 4 DESC, 3 DESC, lower(arg_min(title, o)), 1 LIMIT 20")
def reference_insights(spark, sf_dir):
    return refs_.insights(star.references(spark, sf_dir)).select("ref_key", "title", "citation_count", "relevance_score", "value_score")


def _overlap(words) -> str:
    one = lambda t, key, size: f"SELECT {key}, len(w) AS {size}, unnest(w) AS word FROM (SELECT {key}, list_distinct({TOKENS.format('text', 2, quoted(words))}) AS w FROM {t})"
    return f"SELECT item_id, doc_id, count(*) AS n, x, y FROM ({one('benchmark', 'item_id', 'x')}) b JOIN ({one('documents', 'doc_id', 'y')}) d ON b.word = d.word GROUP BY ALL"


def _relevance(spark, sf_dir, words, bonus: bool) -> DataFrame:
    b, d = star.table(spark, sf_dir, "benchmark"), star.table(spark, sf_dir, "documents").select("doc_id", "text")
    return refs_.relevance_pairs(b.select(F.col("item_id").alias("query_id"), "text"), d, words, bonus).withColumnRenamed("query_id", "item_id")


@query(f"SELECT item_id, doc_id, round(least(1.0::DOUBLE, n / least(x, y)::DOUBLE), 3) AS relevance FROM ({_overlap(refs_.PROFILE_STOPWORDS)})")
def reference_overlap(spark, sf_dir):
    return _relevance(spark, sf_dir, refs_.PROFILE_STOPWORDS, False)


@query(f"SELECT item_id, doc_id, relevance FROM (SELECT item_id, doc_id, round(least(1.0::DOUBLE, n / least(x, y)::DOUBLE + least(0.08::DOUBLE, 0.02::DOUBLE * n)), 3) AS relevance FROM ({_overlap(refs_.SOURCE_STOPWORDS)})) WHERE relevance >= 0.12")
def ris_relevant(spark, sf_dir):
    return _relevance(spark, sf_dir, refs_.SOURCE_STOPWORDS, True).where("relevance >= 0.12")


@query(f"{REFS}, b AS (SELECT *, row_number() OVER (PARTITION BY ref_key ORDER BY relevance_score DESC, ord, pos) AS n FROM keyed WHERE relevance_score >= 0.12 AND ref_key <> '') SELECT title, doi, ord, relevance_score FROM b WHERE n = 1")
def best_reference_by_key(spark, sf_dir):
    return refs_.best_by_key(star.references(spark, sf_dir)).select("title", "doi", F.col("_ord").alias("ord"), "relevance_score")


MERGED = f"""{ARTICLES} SELECT ord, CASE WHEN ord % 2 = 0 THEN 'S1 ' || ord WHEN ord % 3 = 0 THEN 'S2 ' || ord ELSE '' END AS title, CASE WHEN ord % 2 = 0 THEN journal WHEN ord % 3 = 0 THEN subdomain ELSE '' END AS journal,
 CASE WHEN ord % 2 = 0 AND citation_count IS NOT NULL AND c >= CASE WHEN ord % 3 = 0 THEN 100 ELSE -1 END THEN c WHEN ord % 3 = 0 THEN 100 ELSE -1 END AS citation_count,
 CASE WHEN ord % 2 = 0 AND citation_count IS NOT NULL AND c >= CASE WHEN ord % 3 = 0 THEN 100 ELSE -1 END THEN 'openalex' WHEN ord % 3 = 0 THEN 'crossref' END AS citation_source FROM articles"""


@query(MERGED)
def merge_sources(spark, sf_dir):
    rows = star.articles(spark, sf_dir)
    empty = [F.lit("").alias(c) for c in ("title", "journal", "article_type", "publish_date", "abstract", "abstract_source")]
    bare = rows.select("_ord", *empty, *[F.array().cast("array<string>").alias(c) for c in ("authors", "institutions", "metadata_sources")], F.create_map().cast("map<string,int>").alias("citation_counts"), F.lit(None).cast("int").alias("citation_count"), F.lit(None).cast("string").alias("citation_source"))
    name = lambda p: F.concat(F.lit(p), F.col("_ord").cast("string")).alias("title")
    s1 = rows.where("_ord % 2 = 0").select("_ord", name("S1 "), "journal", "article_type", "publish_date", "authors", "institutions", "abstract", "citation_count")
    s2 = rows.where("_ord % 3 = 0").select("_ord", name("S2 "), F.col("subdomain").alias("journal"), "article_type", "publish_date", "authors", "institutions", "abstract", F.lit(100).alias("citation_count"))
    return enrich.merge_sources(bare, [("openalex", s1), ("crossref", s2)], key="_ord").select(F.col("_ord").alias("ord"), "title", "journal", F.coalesce("citation_count", F.lit(-1)).alias("citation_count"), "citation_source")


@query("SELECT user_id, arg_max(event_type, (value, CASE event_type WHEN 'click' THEN 4 ELSE 0 END, event_type)) AS source, max(value) AS best FROM (SELECT user_id, event_type, CAST(floor(max(value)) AS INTEGER) AS value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def best_citation_source(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events").where("value IS NOT NULL AND event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.floor(F.max("value")).cast("int").alias("v"))
    kind = F.when(F.col("event_type") == "click", "semantic-scholar").otherwise(F.col("event_type"))
    counts = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(kind.alias("k"), F.col("v").alias("v")))).alias("counts"))
    best = enrich.best_citation(F.col("counts"))
    return counts.select("user_id", F.when(best["source"] == "semantic-scholar", "click").otherwise(best["source"]).alias("source"), best["count"].alias("best"))


@query("SELECT doc_id, layer, lang FROM (SELECT doc_id, layer, lang, row_number() OVER (PARTITION BY text ORDER BY layer, doc_id) AS n FROM (SELECT *, CASE WHEN source IN ('src0', 'src1') THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS layer FROM documents)) WHERE n = 1")
def layered_union_dedupe(spark, sf_dir):
    d = star.table(spark, sf_dir, "documents").withColumn("_ord", F.col("doc_id"))
    first = F.coalesce(F.col("source").isin("src0", "src1"), F.lit(False))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return enrich.first_wins([d.where(first), d.where(~first & english), d.where(~first & ~english)], F.col("text")).select("doc_id", F.col("_layer").alias("layer"), "lang")


def _term(text: str, term: str) -> str:
    # no lookaround here: every separator is doubled, so that matches don't share one
    if " " in term:
        return f"((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)})::INT"
    return f"len(regexp_extract_all(regexp_replace({text}, '[^a-z0-9]', '  ', 'g'), '(?:^|[^a-z0-9]){term}(?:[^a-z0-9]|$)'))"


_scores = ", ".join(f"struct_pack(less := -({' + '.join(f'4 * {_term("tt", t)} + {_term("xx", t)}' for t in ts)}), domain := '{d}')" for d, ts in sorted(RULES))


@query(f"WITH {DOCS}, low AS (SELECT ord, lower(title) AS tt, lower(title || ' ' || abstract || ' article ' || journal) AS xx FROM docs), s AS (SELECT ord, list_min([{_scores}]) AS b FROM low) SELECT ord, CASE WHEN b.less < 0 THEN b.domain ELSE '未分类' END AS domain, CASE WHEN b.less < 0 THEN round(least(0.72::DOUBLE, 0.58::DOUBLE + 0.02::DOUBLE * least(-b.less, 7)), 3) ELSE 0.0 END AS confidence FROM s")
def rule_classify(spark, sf_dir):
    return classify.rule_classify(star.texts(spark, sf_dir), RULES).select(F.col("_ord").alias("ord"), "domain", "confidence")


@query("WITH e AS (SELECT doc_id AS id, 1 AS pos, CASE WHEN quality = 1 THEN 'openalex' ELSE 'crossref' END AS source, CASE WHEN toxic = 1 THEN 'topic' ELSE 'concept' END AS taxonomy, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'd' || doc_id % 3 END AS domain, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM labels UNION ALL SELECT doc_id, 0, 'crossref', 'subject', 'd' || doc_id % 4, 0.72::DOUBLE FROM labels) SELECT id, source, taxonomy, domain, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'openalex' THEN 1 ELSE 2 END, CASE taxonomy WHEN 'topic' THEN 1 WHEN 'concept' THEN 2 ELSE 3 END, confidence DESC, pos) AS n FROM e WHERE domain <> '') WHERE n = 1")
def best_evidence(spark, sf_dir):
    return classify.best_evidence(_evidence(spark, sf_dir)).select("id", "source", "taxonomy", "domain", "confidence")


def _evidence(spark, sf_dir):
    rows, k = star.table(spark, sf_dir, "labels"), F.col("doc_id")
    word = lambda n: F.concat(F.lit("d"), (k % n).cast("string"))
    one = rows.select(k.alias("id"), F.lit(1).alias("pos"), F.when(F.col("quality") == 1, "openalex").otherwise("crossref").alias("source"), F.when(F.col("toxic") == 1, "topic").otherwise("concept").alias("taxonomy"), F.when(k % 5 == 0, "").otherwise(word(3)).alias("domain"), (k % 10 / 10).alias("confidence"))
    return one.unionByName(rows.select(k.alias("id"), F.lit(0).alias("pos"), F.lit("crossref").alias("source"), F.lit("subject").alias("taxonomy"), word(4).alias("domain"), F.lit(0.72).alias("confidence")))


@query("WITH c AS (SELECT lang AS domain, source, count(*) AS n FROM documents GROUP BY ALL) SELECT domain, source, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, source) AS r FROM c) WHERE r = 1")
def taxonomy_mode(spark, sf_dir):
    return classify.taxonomy_mode(star.table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), "source"))


_TOPIC = TOKENS.format("title || ' ' || abstract || '  '", 2, quoted(tx.TOPIC_STOPWORDS))


@query(f"WITH {DOCS}, t AS (SELECT subdomain, ord, unnest({_TOPIC}) AS token, generate_subscripts({_TOPIC}, 1) AS p, 1 AS w FROM docs), k AS (SELECT subdomain, token, sum(w) AS weight, row_number() OVER (PARTITION BY subdomain ORDER BY sum(w) DESC, min((ord, p))) AS rank FROM t GROUP BY 1, 2) SELECT subdomain, rank, token, CAST(weight AS BIGINT) AS weight FROM k WHERE rank <= 8")
def topic_keywords(spark, sf_dir):
    rows = star.texts(spark, sf_dir).withColumns({"problem_statement": F.lit(""), "solution_summary": F.lit("")})
    return stats.topic_keywords(rows).withColumn("rank", F.col("rank").cast("long"))


_PAPER = TOKENS.format("coalesce(text, '')", 3, quoted(tx.PAPER_STOPWORDS))


@query(f"WITH t AS (SELECT doc_id AS id, unnest({_PAPER}) AS token, generate_subscripts({_PAPER}, 1) AS p FROM documents), k AS (SELECT id, token, count(*) AS count, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(p)) AS rank FROM t GROUP BY 1, 2) SELECT id, rank, token, count FROM k WHERE rank <= 5")
def article_keywords(spark, sf_dir):
    rows = classify.article_keywords(star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", F.col("rank").cast("long").alias("rank"), "token", "count")


@query(f"WITH t AS (SELECT unnest({TOKENS.format('text', 3, quoted(tx.TOPIC_STOPWORDS))}) AS token FROM documents) SELECT token, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def keyword_summary(spark, sf_dir):
    return stats.keyword_summary(star.table(spark, sf_dir, "documents"))


@query(f"WITH s AS (SELECT doc_id, {SENTENCES.format('coalesce(text, chr(32))')} AS s FROM documents) SELECT doc_id, coalesce(s[1], 'untitled') AS problem, CASE WHEN len(s) >= 2 THEN s[len(s) - 1] || ' ' || s[len(s)] WHEN len(s) = 1 THEN s[1] END AS solution FROM s")
def problem_solution(spark, sf_dir):
    return star.table(spark, sf_dir, "documents").select("doc_id", tx.problem_statement(F.col("text"), F.lit("untitled")).alias("problem"), tx.solution_summary(F.col("text")).alias("solution"))


def _text_sql() -> str:
    out = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', ' ', 'g')"
    for tag in pages_.HIDDEN:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, char in pages_._ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_text_sql()} AS text FROM pages")
def page_text(spark, sf_dir):
    return star.table(spark, sf_dir, "pages").select("page_id", pages_.visible_text(F.col("html")).alias("text"))


@query()
def page_meta(spark, sf_dir):
    return pages_.page_meta(star.table(spark, sf_dir, "pages"))


_LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']"""


@query(f"SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{_LINK}', 1))) AS link FROM pages)")
def listing_links(spark, sf_dir):
    return star.table(spark, sf_dir, "pages").select("page_id", F.explode(pages_.links(F.col("html"))).alias("link"))


COS = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@query(f"WITH q AS (SELECT vec_id AS place, 'q' || vec_id AS purpose, embedding FROM embeddings WHERE vec_id < 4), c AS (SELECT e.vec_id AS id, purpose, {COS} AS s, row_number() OVER (PARTITION BY e.vec_id ORDER BY {COS} DESC, place) AS n FROM embeddings e, q) SELECT id, purpose, round(s, 9) AS similarity FROM c WHERE n = 1")
def cosine_best_purpose(spark, sf_dir):
    e = star.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("id < 4").select(F.col("id").alias("place"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("purpose"), F.col("v").alias("q"))
    return evidence.best_purpose(e, q).withColumn("similarity", F.round("similarity", 9))


@query()
def embedding_clusters(spark, sf_dir):
    e = star.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return linkage.clusters(e, "label")


def _chunks(spark, sf_dir):
    return evidence.chunk_documents(star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query()
def chunk_scores(spark, sf_dir):
    return evidence.score_chunks(_chunks(spark, sf_dir)).select("chunk_id", "section", F.round("lexical_score", 6).alias("lexical_score"), F.array_join("reasons", ",").alias("reasons"))


def _selection(spark, sf_dir):
    scored = evidence.score_chunks(_chunks(spark, sf_dir)).withColumn("score", F.col("lexical_score")).drop("text")
    scored = cut(scored, "chunks")  # read by several windows and sums
    return scored, evidence.select_evidence(scored, 4)


@query()
def evidence_selection(spark, sf_dir):
    return _selection(spark, sf_dir)[1].select("id", "chunk_id", "section", F.round("score", 6).alias("score"))


@query()
def evidence_coverage(spark, sf_dir):
    return evidence.coverage(*_selection(spark, sf_dir)).select("id", "coverage_status", F.array_join("missing_reasons", ",").alias("missing_reasons"))


@query("""WITH p AS (SELECT lang AS domain, CASE WHEN l.quality IS NULL THEN NULL WHEN quality = 1 THEN 'pdf_text' ELSE 'abstract_only' END AS basis, coalesce(toxic = 0, false) AS has_chunks, CASE WHEN toxic = 1 THEN 'low' WHEN toxic = 0 THEN 'ok' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT domain, count(*) AS selected_papers, count(basis) AS analyzed_papers, count(*) FILTER (WHERE basis = 'pdf_text') AS from_pdf_text, count(*) FILTER (WHERE basis = 'abstract_only') AS from_abstract_only, count(*) FILTER (WHERE has_chunks) AS with_chunks, count(*) FILTER (WHERE status = 'ok') AS coverage_ok, count(*) FILTER (WHERE status = 'low') AS coverage_low FROM p GROUP BY 1)
SELECT domain, selected_papers, analyzed_papers, coverage_ok, coverage_low, selected_papers - analyzed_papers AS failed_or_missing, round(from_pdf_text / selected_papers::DOUBLE, 3) AS full_text_ratio, round(with_chunks / selected_papers::DOUBLE, 3) AS semantic_ratio,
CASE WHEN analyzed_papers = 0 THEN 'low' WHEN from_pdf_text / selected_papers::DOUBLE >= 0.67 AND with_chunks / selected_papers::DOUBLE >= 0.67 AND selected_papers = analyzed_papers THEN 'high' WHEN from_pdf_text / selected_papers::DOUBLE >= 0.33 OR (from_pdf_text + from_abstract_only) / selected_papers::DOUBLE >= 0.67 THEN 'medium' ELSE 'low' END AS reliability FROM g""")
def domain_reliability(spark, sf_dir):
    d, l = star.table(spark, sf_dir, "documents"), star.table(spark, sf_dir, "labels")
    p = d.select("doc_id", "lang").join(l, "doc_id", "left")
    p = p.select(F.col("lang").alias("domain"), F.when(F.col("quality") == 1, "pdf_text").when(F.col("quality").isNotNull(), "abstract_only").alias("basis"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("has_chunks"), F.when(F.col("toxic") == 1, "low").when(F.col("toxic") == 0, "ok").alias("status"))
    return evidence.domain_reliability(p).select("domain", "selected_papers", "analyzed_papers", "coverage_ok", "coverage_low", "failed_or_missing", "full_text_ratio", "semantic_ratio", "reliability")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND doc_id % 5 = 0")
def ungrounded_snippets(spark, sf_dir):
    """The last sentence of every document against its whole text; every fifth has a snippet that no text holds."""
    last = F.coalesce(F.try_element_at(tx.sentences(F.col("text")), F.lit(-1)), F.lit(""))  # a blank text has none, and may come here before it is left out
    rows = star.table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\p{Zs}]"))  # as SQL's trim sees it: a space of any kind, no tab or line end
    snippet = F.when(F.col("doc_id") % 5 == 0, F.format_string("q%d 0zxq 9vkj", "doc_id")).otherwise(last)
    return evidence.ungrounded(rows.select("doc_id", snippet.alias("snippet"), "text")).select("doc_id")


@query("WITH k AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents) SELECT item_id FROM benchmark WHERE trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) NOT IN (SELECT k FROM k WHERE k IS NOT NULL)")
def unknown_papers(spark, sf_dir):
    b, d = star.table(spark, sf_dir, "benchmark"), star.table(spark, sf_dir, "documents")
    return evidence.unknown_papers(b.withColumnRenamed("text", "title"), d.withColumnRenamed("text", "title")).select("item_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IS NOT NULL) AS event_type, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY 1")
def latest_status(spark, sf_dir):
    return monitor.latest_state(star.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT event_type, event_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def recent_events(spark, sf_dir):
    rows = monitor.last_events(star.table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 20)
    return rows.select("event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, array_to_string(list(w ORDER BY p, w), ' ') AS abstract FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def inverted_abstract(spark, sf_dir):
    """Every document's words with their places, and the text made from these again."""
    rows = star.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").repartition("doc_id")  # texts move once, words never
    words = rows.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", tx.inverted_abstract(F.col("index")).alias("abstract"))


@query(f"""{ARTICLES} SELECT ord, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || array_to_string(list_transform(authors, lambda a: 'AU  - ' || a || chr(10)), '') || 'PY  - ' || left(publish_date, 4) || chr(10) || CASE WHEN doi <> '' THEN 'DO  - ' || doi || chr(10) ELSE '' END || CASE WHEN journal <> '' THEN 'JF  - ' || journal || chr(10) ELSE '' END || 'ER  -' || chr(10) AS ris FROM articles""")
def ris_text(spark, sf_dir):
    return star.articles(spark, sf_dir).select(F.col("_ord").alias("ord"), sinks.ris_record().alias("ris"))

