"""Statistics of a collection of articles. Every count is one aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import is_research, is_review
from ..functions.text import extract_year, tokens


def year_or_unknown() -> Column:
    y = extract_year(F.col("publish_date"))
    return F.when(y == "", "Unknown").otherwise(y)


def cited() -> Column:
    return F.coalesce("citation_count", F.lit(0))


def group_counts(articles: DataFrame, key: Column, name: str, many: bool = False, *more: Column) -> DataFrame:
    """paper_count and citation_count by a key (``many``: by each of an array's, once a paper), trimmed, blanks dropped."""
    keys = F.array_distinct(F.filter(F.transform(key if many else F.array(key), lambda k: F.trim(k)), lambda k: k != ""))
    rows = articles.withColumn("_key", F.explode(keys))
    return rows.groupBy(F.col("_key").alias(name)).agg(F.count("*").alias("paper_count"), F.sum(cited()).cast("long").alias("citation_count"), *more)


def ranked(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """By citations, papers, name; the first ``most``."""
    out = rows.orderBy(F.desc("citation_count"), F.desc("paper_count"), F.lower(name), name)
    return out if most is None else out.limit(most)


def team_label() -> Column:
    a, i = F.col("authors"), F.col("institutions")
    return F.when(F.size(i) > 0, F.get(i, F.lit(0))).when(F.size(a) >= 2, F.concat(F.get(a, F.lit(0)), F.lit(" + "), F.get(a, F.lit(1)))).when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise("Unknown")


def citation_bucket() -> Column:
    c = cited()
    return F.when(c <= 0, "0").when(c < 10, "1-9").when(c < 50, "10-49").when(c < 100, "50-99").otherwise("100+")


def collaboration_type() -> Column:
    n = F.size("authors")
    team = F.when(n <= 1, "single_author").when(n <= 3, "small_team").when(n <= 10, "medium_team").otherwise("large_team")
    return F.concat(team, F.when(F.size("institutions") <= 1, "_single_institution").otherwise("_multi_institution"))


def source_or_unknown() -> Column:
    return F.when(F.trim("classification_source") == "", "unknown").otherwise(F.trim("classification_source"))


def subdomain_stats(articles: DataFrame) -> DataFrame:
    """Counts of a subdomain, pivoted by where its papers' classification came from."""
    s = source_or_unknown()
    pivot = [F.count_if(s == k).alias(f"{k}_count") for k in ("pubmed_mesh", "openalex", "crossref", "local_rule")]
    return group_counts(articles, F.coalesce("subdomain", F.lit("Other")), "subdomain", False, *pivot, F.count_if(s.isin("none", "unknown")).alias("unclassified_count"))


def subdomain_year(articles: DataFrame) -> DataFrame:
    return articles.groupBy(year_or_unknown().alias("year"), "subdomain").agg(F.count("*").alias("paper_count"), F.sum(cited()).cast("long").alias("citation_count"))


def topic_trends(articles: DataFrame) -> DataFrame:
    """unknown without years, new with one, else by papers of the last two years against those of the first two."""
    years = articles.select("subdomain", extract_year(F.col("publish_date")).try_cast("int").alias("y"))
    counts = years.groupBy("subdomain", "y").agg(F.count("*").alias("n"))  # few rows from here on
    w = Window.partitionBy("subdomain")
    rows = counts.withColumns({"first": F.min("y").over(w), "last": F.max("y").over(w)})
    late, early = F.sum(F.when(F.col("y") >= F.col("last") - 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") <= F.col("first") + 1, F.col("n")).otherwise(0))
    trend = F.when(F.max("y").isNull(), "unknown").when(F.min("y") == F.max("y"), "new").when(late > early, "rising").when(late < early, "declining").otherwise("stable")
    span = F.when(F.max("y").isNull(), "Unknown").otherwise(F.concat(F.min("y").cast("string"), F.lit("-"), F.max("y").cast("string")))
    return rows.groupBy("subdomain").agg(trend.alias("trend"), span.alias("year_span"))


def top_titles(articles: DataFrame, by: list[Column], name: str, most: int = 3) -> DataFrame:
    """The first titles of every subdomain in an order, joined by bars; only ``most`` rows of a group are kept while sorting."""
    w = Window.partitionBy("subdomain").orderBy(*by, "_ord")
    top = articles.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    return top.groupBy("subdomain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda x: x["title"]), " | ").alias(name))


def topic_keywords(articles: DataFrame, most: int = 8) -> DataFrame:
    """(subdomain, rank, token, weight): tokens of the papers count one, those of the label three; equal weights in the order
    in which they come up first, the label's first."""
    text = F.concat_ws(" ", "title", "abstract", "problem_statement", F.coalesce("solution_summary", F.lit("")))
    own = articles.select("subdomain", F.col("_ord").alias("o"), F.lit(1).alias("weight"), F.posexplode(tokens(text)).alias("p", "token"))
    label = articles.select("subdomain").distinct()
    label = label.select("subdomain", F.lit(-1).cast("long").alias("o"), F.lit(3).alias("weight"), F.posexplode(tokens(F.replace(F.replace("subdomain", F.lit("Topic_"), F.lit("")), F.lit("_"), F.lit(" ")))).alias("p", "token"))
    counts = own.unionByName(label).groupBy("subdomain", "token").agg(F.sum("weight").alias("weight"), F.min(F.struct("o", "p")).alias("first"))
    w = Window.partitionBy("subdomain").orderBy(F.desc("weight"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("subdomain", "rank", "token", "weight")


def topic_profiles(articles: DataFrame) -> DataFrame:
    """A row for each subdomain: counts, mean citations, keywords, first and most cited titles, years, trend."""
    base = articles.groupBy("subdomain").agg(F.count("*").alias("paper_count"), F.sum(cited()).cast("long").alias("citation_count"), F.round(F.avg(cited()), 2).alias("average_citations"))
    words = topic_keywords(articles).groupBy("subdomain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), "; ").alias("representative_keywords"))
    first = top_titles(articles, [], "representative_papers")
    best = top_titles(articles, [F.desc(cited())], "top_cited_papers")
    out = base.join(topic_trends(articles), "subdomain").join(words, "subdomain", "left").join(first, "subdomain").join(best, "subdomain")
    return out.withColumn("representative_keywords", F.coalesce("representative_keywords", F.lit("")))


def growing(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("trend").isin("rising", "new")).orderBy(F.col("trend") != "rising", F.desc("paper_count"), F.lower("subdomain"))


def corpus_summary(articles: DataFrame) -> DataFrame:
    """One row over the whole collection. Distinct names are counted in aggregations of their own, not in one with all rows."""
    year = F.nullif(extract_year(F.col("publish_date")), F.lit(""))
    base = articles.agg(
        F.count("*").alias("total_papers"), F.coalesce(F.min(year), F.lit("")).alias("year_min"), F.coalesce(F.max(year), F.lit("")).alias("year_max"),
        F.coalesce(F.sum(cited()), F.lit(0)).cast("long").alias("total_citations"), F.coalesce(F.round(F.avg(cited()), 2), F.lit(0.0)).alias("average_citations"), F.coalesce(F.round(F.median(cited()), 2), F.lit(0.0)).alias("median_citations"),
        F.coalesce(F.round(F.avg(((F.col("pdf_status") == "complete") & (F.col("local_pdf_path") != "")).cast("int")), 3), F.lit(0.0)).alias("open_fulltext_coverage"),
        F.count_if(is_review(F.col("article_type"), F.col("title"))).alias("review_papers"), F.count_if(is_research(F.col("article_type"), F.col("title"))).alias("research_papers"),
    )
    names = [articles.select(F.explode(c).alias("v")).agg(F.count_distinct("v").alias(f"unique_{c}")) for c in ("authors", "institutions")]
    return base.crossJoin(F.broadcast(names[0])).crossJoin(F.broadcast(names[1]))  # single rows


def fold_tail(rows: DataFrame, name: str, top: int, measures: list[str]) -> DataFrame:
    """All rows beyond the first ``top`` (by citations, papers, name) as one that says how many they are. The first are a sorted
    limit, the rest the totals without them: no task sees all groups."""
    rows = rows.select(name, *measures)
    if top <= 0:
        return rows
    head = ranked(rows, name, top)
    total = lambda part, tag: part.agg(F.count("*").alias(f"{tag}_n"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(f"{tag}_{m}") for m in measures])
    rest = total(rows, "a").crossJoin(F.broadcast(total(head, "h"))).where("a_n > h_n")  # single rows
    tail = rest.select(F.format_string("其他领域 (%d 类)", F.col("a_n") - F.col("h_n")).alias(name), *[(F.col(f"a_{m}") - F.col(f"h_{m}")).alias(m) for m in measures])
    return head.unionByName(tail)


def basic_rankings(articles: DataFrame) -> DataFrame:
    """Histograms by author, institution, journal, subdomain as (kind, name, count). An author named twice in a paper counts
    twice here."""
    parts = [articles.select(F.lit(k).alias("kind"), F.explode(c).alias("name")) for k, c in (("author", F.col("authors")), ("institution", F.col("institutions")), ("journal", F.array("journal")), ("subdomain", F.array("subdomain")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.where("name <> ''").groupBy("kind", "name").agg(F.count("*").alias("count"))


def keyword_summary(texts: DataFrame, most: int = 20, least: int = 4) -> DataFrame:
    """The most frequent tokens of a column ``text``, ties by token."""
    return texts.select(F.explode(tokens(F.col("text"), least=least)).alias("token")).groupBy("token").count().orderBy(F.desc("count"), "token").limit(most)
