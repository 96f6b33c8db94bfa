"""Registered queries over crawls, runs, titles and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import classify, crawl, download, evidence, pdf, references as refs_, similar
from ..schema import normalise_articles
from ..sources import lookups, open_access, pages, star
from ..streaming import runs
from ..tables import cut
from .catalogue import ARTICLES, DOCS, TOKENS, query, quoted

# --- a crawl over the order tables as a web: a page of each region lists its nations, theirs their customers, then orders, then parts ------


def _web(spark, sf_dir) -> DataFrame:
    """(url, html): each row's page with links to the rows below it, in the order of their keys; relative ones on one level."""
    t = lambda n: star.table(spark, sf_dir, n)
    levels = (
        (t("nation"), "region", "n_regionkey", "http://tables.example/nation/", "n_nationkey"), (t("customer"), "nation", "c_nationkey", "/customer/", "c_custkey"),
        (t("orders"), "customer", "o_custkey", "../order/", "o_orderkey"), (t("lineitem"), "order", "l_orderkey", "http://tables.example/part/", "l_partkey"),
    )
    made = []
    for rows, name, parent, base, key in levels:
        href = F.transform(F.sort_array(F.collect_set(key)), lambda k: F.concat(F.lit(f'<a href="{base}'), k.cast("string"), F.lit('">x</a>')))
        made.append(rows.where(f"{parent} IS NOT NULL").groupBy(parent).agg(F.array_join(href, " ").alias("html")).select(F.concat(F.lit(f"http://tables.example/{name}/"), F.col(parent).cast("string")).alias("url"), "html"))
    out = made[0]
    for p in made[1:]:
        out = out.unionByName(p)
    return out


def _level(n: int, child: str, key: str, rows: str, parent_key: str) -> str:
    return f"""m{n} AS (SELECT '{child}/' || {key} AS url, min((place, {key})) AS met, arg_min(m.url, (place, {key})) AS parent FROM l{n - 1} m JOIN {rows} ON m.url = {parent_key} GROUP BY 1),
l{n} AS (SELECT url, {n} AS depth, (SELECT count(*) FROM a{n - 1}) + row_number() OVER (ORDER BY met) - 1 AS place, parent FROM m{n}), a{n} AS (SELECT * FROM a{n - 1} UNION ALL SELECT * FROM l{n})"""


@query(f"""WITH l0 AS (SELECT 'http://tables.example/region/' || r_regionkey AS url, 0 AS depth, row_number() OVER (ORDER BY r_regionkey) - 1 AS place, NULL::VARCHAR AS parent FROM region), a0 AS (SELECT * FROM l0),
{_level(1, "http://tables.example/nation", "n_nationkey", "nation", "'http://tables.example/region/' || n_regionkey")},
{_level(2, "http://tables.example/customer", "c_custkey", "customer", "'http://tables.example/nation/' || c_nationkey")},
{_level(3, "http://tables.example/order", "o_orderkey", "orders", "'http://tables.example/customer/' || o_custkey")},
{_level(4, "http://tables.example/part", "l_partkey", "lineitem", "'http://tables.example/order/' || l_orderkey")}
SELECT url, depth, place, parent FROM a4""")
def crawl_order(spark, sf_dir):
    """A breadth-first crawl from all regions: a part is met where its first order lists it."""
    web = cut(_web(spark, sf_dir), "web")  # each round reads it
    seeds = star.table(spark, sf_dir, "region").select(F.concat(F.lit("http://tables.example/region/"), F.col("r_regionkey").cast("string")).alias("url"), F.col("r_regionkey").cast("long").alias("place"))
    return crawl.crawl(seeds, lambda front: web.join(front, "url"))


# --- runs: each user's events as the updates of a run ---------------------------------------------------------------------------


def _updates(spark, sf_dir) -> DataFrame:
    k = F.col("event_type")
    return star.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run "), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("seq"), "ts", F.when(k == "purchase", "completed").when(k == "error", "failed").otherwise("running").alias("status"), F.when(k != "view", k).alias("stage"),
        F.when(k != "click", F.col("props")).alias("message"), F.lit(None).cast("string").alias("current_item"), F.when(k == "click", F.floor("value")).cast("long").alias("processed"), F.lit(None).cast("long").alias("total"), F.when(k != "signup", k).alias("metric"), F.floor("value").cast("string").alias("value"), k.alias("event"),
    )


@query("""WITH u AS (SELECT 'run ' || user_id AS run, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type <> 'view' THEN event_type END AS stage,
 CASE WHEN event_type <> 'click' THEN props END AS message, CASE WHEN event_type = 'click' THEN floor(value)::BIGINT END AS processed, event_type AS event, floor(value)::BIGINT::VARCHAR AS value FROM events),
m AS (SELECT run, event, arg_max(value, (ts, seq)) AS value FROM u WHERE event <> 'signup' GROUP BY ALL), n AS (SELECT run, string_agg(event || '=' || value, ',' ORDER BY event) AS metrics FROM m GROUP BY run),
e AS (SELECT run, string_agg(seq::VARCHAR || ':' || event, ',' ORDER BY ts, seq) AS events FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, seq DESC) <= 100) GROUP BY run)
SELECT run, max((ts, seq))[2] AS seq, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, arg_max(status, (ts, seq)) AS status, arg_max(stage, (ts, seq)) FILTER (stage IS NOT NULL) AS stage, arg_max(message, (ts, seq)) FILTER (message IS NOT NULL) AS message, arg_max(processed, (ts, seq)) FILTER (processed IS NOT NULL) AS processed,
 strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(max(ts) FILTER (status <> 'running'), '%Y-%m-%d %H:%M:%S.%f') AS finished_at, any_value(metrics) AS metrics, any_value(events) AS events FROM u LEFT JOIN n USING (run) LEFT JOIN e USING (run) GROUP BY run""")
def run_states(spark, sf_dir):
    rows = runs.run_states(_updates(spark, sf_dir))
    metrics = F.array_join(F.transform(F.sort_array(F.map_entries("metrics")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    told = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["type"])), ",")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select("run", "seq", at("ts"), "status", "stage", "message", "processed", at("started_at"), at("finished_at"), F.nullif(metrics, F.lit("")).alias("metrics"), F.nullif(told, F.lit("")).alias("events"))


# --- titles and clusters --------------------------------------------------------------------------------------------------------


@query()
def title_matches(spark, sf_dir):
    """The titles of pages among the first sentences of all documents."""
    heads = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.first_sentence(F.col("text")).alias("title"))
    titles = star.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), pages.title(F.col("html")).alias("title"))
    return similar.best_matches(titles, heads)


@query()
def cluster_classified(spark, sf_dir):
    """The texts of each label's vectors, where there is a document of the same id, named after their clusters."""
    e = star.table(spark, sf_dir, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    texts = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return classify.classify_batch(e.join(texts, "id", "left"), "collection")


# --- files of papers ------------------------------------------------------------------------------------------------------------


@query(f"""{ARTICLES}, n AS (SELECT ord, subdomain AS folder, doi, title, '（' || CASE WHEN year = '' THEN '未知年份' ELSE year END || '，' || CASE WHEN journal = '' THEN '未知期刊' ELSE upper(journal[1]) END || '）' AS head,
 '（' || CASE WHEN len(authors) = 0 THEN '未知作者' ELSE authors[1] END || '，' || CASE WHEN len(institutions) = 0 THEN '未知机构' ELSE institutions[1] END || '）.pdf' AS tail FROM articles),
s AS (SELECT *, CASE WHEN ord % 10 = 0 THEN 'skipped_existing' WHEN ord % 10 = 1 AND doi <> '' OR ord % 10 = 2 THEN 'skipped_existing_renamed' WHEN doi = '' THEN 'skipped' ELSE 'fetch' END AS step, CASE ord % 10 WHEN 0 THEN head || title || tail WHEN 1 THEN nullif(replace(doi, '/', '_'), '') || '.pdf' WHEN 2 THEN head || title || '（old.pdf' END AS found FROM n),
a AS (SELECT doc_id AS ord, '%PDF-' || coalesce(text, '') AS body FROM documents WHERE text IS NOT NULL),
j AS (SELECT s.*, body, CASE WHEN body IS NULL THEN NULL WHEN strlen(body) < 2000 THEN 'too_small' WHEN regexp_matches(lower(body), 'subscribe|purchase|log in|login|institutional access|access this article') THEN 'paywalled_or_incomplete' WHEN NOT regexp_matches(lower(body), 'abstract|references') THEN 'missing_paper_markers' ELSE 'complete' END AS state FROM s LEFT JOIN a USING (ord))
SELECT ord, CASE WHEN step <> 'fetch' THEN step WHEN body IS NULL THEN 'pending' WHEN state = 'complete' THEN 'downloaded' ELSE 'skipped' END AS download_status,
 CASE WHEN step LIKE 'skipped_existing%' THEN 'complete' WHEN step = 'skipped' THEN 'missing_pdf_url' WHEN body IS NULL THEN 'unchecked' ELSE state END AS pdf_status, coalesce(found, '') AS found FROM j""")
def download_states(spark, sf_dir):
    """Every paper's file: some are there under their name, their DOI's or a name cut off elsewhere; documents are the answers."""
    rows = star.articles(spark, sf_dir).select(F.col("_ord").alias("id"), F.col("subdomain").alias("folder"), pdf.file_name().alias("name"), "doi", F.col("doi").alias("pdf_url"))
    rows = cut(rows, "papers")  # the files are made from them, and joined in three ways
    kind = F.col("id") % 10
    cut_off = F.concat(F.regexp_extract("name", "^(（[^）]*）[^（]*)", 1), F.lit("（old.pdf"))
    files = rows.select("folder", F.when(kind == 0, F.col("name")).when(kind == 1, download.doi_name(F.col("doi"))).when(kind == 2, cut_off).alias("name")).where("name IS NOT NULL")
    answers = star.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.encode(F.concat(F.lit("%PDF-"), "text"), "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    out = download.settled(download.planned(rows, files), answers, least=2000)
    return out.select(F.col("id").alias("ord"), "download_status", "pdf_status", F.coalesce("found", F.lit("")).alias("found"))


# --- references of texts, evidence of services, vectors of chunks ----------------------------------------------------------------


@query(f"""{ARTICLES}, r AS (SELECT l_orderkey AS ord, l_linenumber AS pos, p_partkey AS p, 'Report on the ' || p_name || ' number ' || p_partkey AS title, CASE WHEN p_partkey % 3 > 0 THEN '10.2000/' || p_partkey ELSE '' END AS doi,
 regexp_extract('Report on the ' || p_name || ' number ' || p_partkey || '. Journal of Trade 7, ' || (1990 + p_partkey % 30), '\\b(?:19|20)\\d{{2}}\\b') AS year FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, row_number() OVER (PARTITION BY ord, p ORDER BY pos) AS n FROM r), g AS (SELECT ord, count(*) AS found, string_agg(title || '|' || doi || '|' || year || '|Journal of Trade', ';' ORDER BY pos, p) AS refs FROM k WHERE n = 1 GROUP BY ord)
SELECT ord, CASE WHEN ord % 11 = 0 THEN coalesce(found, 0) ELSE 1 END::INT AS found, CASE WHEN ord % 11 = 0 THEN coalesce(refs, '') ELSE 'old|||' END AS refs FROM articles LEFT JOIN g USING (ord)""")
def extracted_references(spark, sf_dir):
    """Order lines as the reference section of a text, read back into the articles whose file is complete."""
    line = star.table(spark, sf_dir, "lineitem").join(star.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = F.col("p_partkey")
    told = F.concat(F.lit(". Maker, A. & Seller, B. C. Report on the "), "p_name", F.lit(" number "), p.cast("string"), F.lit(". Journal of Trade 7, "), (1990 + p % 30).cast("string"), F.lit("."), F.when(p % 3 > 0, F.concat(F.lit(" https://doi.org/10.2000/"), p.cast("string"), F.lit("."))).otherwise(""))
    lists = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", p.alias("p"), told.alias("t")))).alias("x"))
    texts = lists.select("id", F.concat(F.lit("Body.\nREFERENCES\n"), F.array_join(F.transform("x", lambda x: F.concat(x["l_linenumber"].cast("string"), x["t"])), "\n"), F.lit("\nAcknowledgements\n9. Nobody, N. Not a reference at all.")).alias("text"))
    old = F.array(F.struct(F.lit("old").alias("title")))
    rows = normalise_articles(star.articles(spark, sf_dir))
    rows = rows.withColumn("references", F.from_json(F.to_json(old), rows.schema["references"].dataType))
    out = refs_.with_extracted(rows.withColumn("id", F.col("_ord")), texts)
    field = lambda r, n: F.coalesce(r[n], F.lit(""))
    return out.select(F.col("_ord").alias("ord"), F.size("references").alias("found"), F.array_join(F.transform("references", lambda r: F.concat_ws("|", field(r, "title"), field(r, "doi"), field(r, "publish_date"), field(r, "journal"))), ";").alias("refs"))


@query("SELECT l_orderkey AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_partkey) - 1 AS pos, p_name AS title, '10.1000/' || l_orderkey AS source_doi FROM lineitem JOIN part ON l_partkey = p_partkey")
def nested_references(spark, sf_dir):
    """Cited works nested in their articles, and taken out again."""
    flat = star.references(spark, sf_dir)
    nested = flat.groupBy("_ord", F.col("source_doi").alias("doi"), F.col("source_title").alias("t")).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("title", "journal").alias("r")))).alias("x"))
    rows = nested.select("_ord", "doi", F.col("t").alias("title"), F.transform("x", lambda x: x["r"]).alias("references"))
    return refs_.unnest(rows).select(F.col("_ord").alias("ord"), F.col("pos").cast("long").alias("pos"), "title", "source_doi")


@query(f"""{ARTICLES}, s AS (SELECT *, CASE WHEN ord % 5 = 0 AND ord % 10 <> 0 THEN 'F' || ord % 3 WHEN ord % 5 = 1 THEN 'P' || ord % 3 WHEN ord % 5 = 2 THEN 'Q' END AS given, CASE journal WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'HOUSEHOLD' THEN 'Homes' WHEN 'FURNITURE' THEN 'Homes' END AS ruled FROM articles)
SELECT ord, coalesce(given, ruled, '未分类') AS subdomain, CASE WHEN given IS NULL THEN CASE WHEN ruled IS NULL THEN 'none' ELSE 'local_rule' END WHEN ord % 5 = 1 THEN 'crossref' ELSE 'openalex' END AS source,
 CASE WHEN given IS NULL THEN CASE WHEN ruled IS NULL THEN 0.0 ELSE 0.6 END WHEN ord % 5 = 0 THEN 0.9 WHEN ord % 5 = 1 THEN 0.72 ELSE 0.5 END::DOUBLE AS confidence FROM s""")
def authoritative_classes(spark, sf_dir):
    """Topics on the record, even ones that yield nothing, before the first service with an answer, before rules."""
    k, text = F.col("_ord"), "array<struct<source:string,taxonomy:string,label:string,field:string,subfield:string,topic:string,level:int,score:double>>"
    topic = lambda kind, name, score: F.struct(F.lit("openalex").alias("source"), F.lit(kind).alias("taxonomy"), F.lit("l").alias("label"), name.alias("field"), F.lit("").alias("subfield"), F.lit("").alias("topic"), F.lit(None).cast("int").alias("level"), F.lit(score).alias("score"))
    field = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("F"), (k % 3).cast("string")))
    rows = star.articles(spark, sf_dir).withColumn("authoritative_topics", F.when(k % 5 == 0, F.array(topic("concept", F.when(k % 10 == 0, "").otherwise("C"), 0.99), topic("topic", field, 0.9))).otherwise(F.array().cast(text)).cast(text)).withColumn("id", k)
    told = lambda name, pos, source, kind, domain, sure: rows.where(k % 5 != 3).select("id", F.lit(name).alias("provider"), F.lit(pos).alias("pos"), F.lit(source).alias("source"), F.lit(kind).alias("taxonomy"), F.lit("l").alias("label"), domain.alias("domain"), F.lit(sure).alias("confidence"))
    first = told("a", 0, "openalex", "concept", F.when(k % 5 == 2, "Q").otherwise(""), 0.5)
    second = told("b", 0, "crossref", "subject", F.when(k % 5 < 3, F.concat(F.lit("P"), (k % 3).cast("string"))).otherwise(""), 0.72)
    out = classify.authoritative(rows, first.unionByName(second), [("Cars", ["automobile"]), ("Homes", ["household", "furniture"])])
    return out.select(F.col("id").alias("ord"), F.col("subdomain"), F.col("classification_source").alias("source"), F.col("classification_confidence").alias("confidence"))


@query("""WITH q AS (SELECT vec_id AS place, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 4), s AS (SELECT vec_id, place, list_dot_product(embedding::DOUBLE[], q) AS s FROM embeddings, q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, place) = 1)
SELECT vec_id AS id, 'purpose ' || place AS purpose, round(vec_id % 7 / 7.0::DOUBLE + 4 * s + vec_id % 3 / 10.0::DOUBLE, 4) AS score, CASE WHEN place = 2 THEN 1 ELSE 2 END AS reasons FROM b""")
def semantic_chunks(spark, sf_dir):
    """Vectors as scored chunks against four purposes' vectors, with the score of a reranker."""
    e, k = star.table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), F.col("vec_id")
    queries = e.where("vec_id < 4").select(k.alias("place"), F.concat(F.lit("purpose "), k.cast("string")).alias("purpose"), F.col("v").alias("q"))
    chunks = e.select(k.alias("id"), (k % 7 / 7).alias("lexical_score"), F.array(F.lit("purpose 2")).alias("reasons"), "v", (k % 3 / 10).alias("rerank_score"))
    return evidence.semantic_scores(chunks, queries).select("id", F.col("semantic_purpose").alias("purpose"), F.round("score", 4).alias("score"), F.size("reasons").alias("reasons"))


@query(f"""{ARTICLES} SELECT ord, CASE ord % 9 WHEN 0 THEN 'http://own/' || ord || '.pdf' WHEN 1 THEN 'https://journals.plos.org/plosone/article/file?id=10.1371/journal.pone.' || ord || '&type=printable' WHEN 2 THEN 'https://www.mdpi.com/10.3390/a' || ord || '/pdf'
 WHEN 3 THEN 'http://e/' || ord || '/pdf/x' WHEN 4 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || ord || '/pdf/' WHEN 5 THEN 'http://u/' || ord || '.pdf' WHEN 6 THEN 'http://c/' || ord || '.pdf' ELSE '' END AS url,
 CASE ord % 9 WHEN 0 THEN 'provider' WHEN 1 THEN 'plos' WHEN 2 THEN 'mdpi' WHEN 3 THEN 'europe-pmc' WHEN 4 THEN 'europe-pmc' WHEN 5 THEN 'unpaywall' WHEN 6 THEN 'core' ELSE '' END AS resolver FROM articles""")
def open_access_urls(spark, sf_dir):
    """Every service answers for every paper; what differs is the DOI and what the answers hold."""
    k = F.col("_ord")
    s, kind = k.cast("string"), k % 9
    doi = F.when(kind == 1, F.concat(F.lit("https://doi.org/10.1371/JOURNAL.pone."), s)).when(kind == 2, F.concat(F.lit("10.3390/A"), s)).when(kind == 8, "").otherwise(F.concat(F.lit("10.5/"), s))
    rows = star.articles(spark, sf_dir).withColumns({"id": k, "pdf_url": F.when(kind == 0, F.concat(F.lit("http://own/"), s, F.lit(".pdf"))).otherwise(""), "doi": doi})
    told = lambda service, *body: rows.select("id", F.lit(service).alias("service"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in body]).alias("body"))
    epmc = F.when(kind == 3, F.concat(F.lit('"fullTextUrlList": {"fullTextUrl": [{"url": "http://closed.pdf", "documentStyle": "pdf", "availabilityCode": "S"}, {"url": "http://e/'), s, F.lit('/pdf/x", "documentStyle": "html", "availabilityCode": "OA"}]}'))).when(kind.isin(4, 8), F.concat(F.lit('"pmcid": "PMC'), s, F.lit('"'))).otherwise('"pmcid": ""')
    pay = F.when(kind == 5, F.concat(F.lit('{"best_oa_location": {"url_for_pdf": "http://u/page"}, "oa_locations": [{"url_for_pdf": null}, {"url_for_pdf": "http://u/'), s, F.lit('.pdf"}]}'))).otherwise("{}")
    core = F.when(kind == 6, F.concat(F.lit('{"results": [{"downloadUrl": "", "fullTextIdentifier": "http://c/'), s, F.lit('.pdf"}]}'))).otherwise("no json")
    answers = told("europe-pmc", '{"resultList": {"result": [{', epmc, "}]}}").unionByName(told("unpaywall", pay)).unionByName(told("core", core))
    return open_access.resolved(rows, answers).select(k.alias("ord"), F.col("resolved_pdf_url").alias("url"), "resolver")


@query(f"{ARTICLES} SELECT ord, 'E ' || ord AS title, '2005' AS publish_date, 'Lee A|Kim B' AS authors, 3 AS citation_count FROM articles WHERE journal = 'HOUSEHOLD'")
def biomedical_lookups(spark, sf_dir):
    """Only papers of a medical journal are asked for at Europe PMC; all have an answer there."""
    rows = star.articles(spark, sf_dir).withColumn("journal", F.when(F.col("journal") == "HOUSEHOLD", "Household Medicine").otherwise(F.col("journal")))
    k = F.col("_ord").cast("string")
    body = F.concat(F.lit('{"title": "E '), k, F.lit('", "doi": "10.9/'), k, F.lit('", "pubYear": "2005", "authorString": "Lee A; Kim B", "citedByCount": 3}'))
    found = lookups.resolve(rows, rows.select(lookups.lookup_key(F.col("doi"), F.col("title")).alias("key"), body.alias("body")), "europe-pmc")
    return found.select(F.col("_ord").alias("ord"), "title", "publish_date", F.array_join("authors", "|").alias("authors"), "citation_count")


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS u, unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)))) AS p FROM pages),
d AS (SELECT page_id, u, min(p) AS p FROM h GROUP BY ALL), g AS (SELECT page_id, count(*)::INT AS n, string_agg(u, ' ' ORDER BY p) AS hrefs FROM d GROUP BY page_id)
SELECT page_id, coalesce(n, 0) AS n, coalesce(hrefs, '') AS hrefs FROM pages LEFT JOIN g USING (page_id)""")
def page_hrefs(spark, sf_dir):
    """The targets of every page's anchors, first occurrences in order."""
    rows = star.table(spark, sf_dir, "pages").withColumn("u", pages.links(F.col("html")))
    return rows.select("page_id", F.size("u").alias("n"), F.array_join("u", " ").alias("hrefs"))


_PROFILE = f"""WITH {DOCS}, p AS (SELECT left(string_agg(concat_ws(' ', nullif(title, ''), nullif(abstract, ''), nullif(subdomain, '')), ' ' ORDER BY ord) FILTER (concat(title, abstract, subdomain) <> ''), 20000) AS text FROM docs),
pw AS (SELECT list_distinct({TOKENS.format('text', 2, quoted(refs_.PROFILE_STOPWORDS))}) AS pw FROM p), r AS (SELECT item_id, list_distinct({TOKENS.format('text', 2, quoted(refs_.PROFILE_STOPWORDS))}) AS w FROM benchmark),
o AS (SELECT item_id, pw, w, list_sort(list_intersect(pw, w)) AS o FROM r, pw), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT item_id, CASE WHEN item_id % 2 = 0 AND embedding IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(embedding::DOUBLE[], q))), 3) WHEN len(pw) = 0 OR len(w) = 0 THEN 0.0 ELSE round(least(1.0::DOUBLE, len(o) / least(len(pw), len(w))::DOUBLE), 3) END AS relevance,
 CASE WHEN item_id % 2 = 0 AND embedding IS NOT NULL THEN 'embedding cosine similarity' WHEN len(pw) = 0 OR len(w) = 0 THEN 'missing profile/reference text' WHEN len(o) = 0 THEN 'no shared terms' ELSE 'shared terms: ' || array_to_string(o[1:10], ', ') END AS reason FROM o LEFT JOIN embeddings ON vec_id = item_id, q"""


@query(_PROFILE)
def profile_relevance(spark, sf_dir):
    """Benchmark texts as references against the profile of all documents; every other one has a vector, as has the profile."""
    e = star.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    papers = star.texts(spark, sf_dir).withColumns({"problem_statement": F.lit(""), "solution_summary": F.lit(None).cast("string")})
    profile = refs_.profile_of(papers).crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("profile_v"))))  # one row each
    refs = star.table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id"), "left")
    refs = refs.select("item_id", F.col("text").alias("title"), F.lit("").alias("abstract"), F.lit("").alias("journal"), F.array().cast("array<string>").alias("authors"), F.when(F.col("item_id") % 2 == 0, F.col("v")).alias("v"))
    return refs_.against_profile(refs, profile, True).select("item_id", F.col("relevance_score").alias("relevance"), F.col("relevance_reason").alias("reason"))
