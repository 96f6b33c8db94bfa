"""What reports are made of: claims traced to papers, analyses joined to papers, reading lists, patterns over domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_title, tokens


def valid_only(outputs: DataFrame) -> DataFrame:
    """Outputs without a status count as valid."""
    return outputs.where(F.coalesce("validation_status", F.lit("valid")) == "valid")


def analyses_with_papers(analyses: DataFrame, papers: DataFrame) -> DataFrame:
    """Valid analyses (domain, stem, ...) with their paper (domain, paper_id, ...), if there is one."""
    right = papers.withColumnRenamed("paper_id", "stem").withColumn("_found", F.lit(True))
    return valid_only(analyses).join(right, ["domain", "stem"], "left").withColumn("has_paper", F.coalesce("_found", F.lit(False))).drop("_found")


def trace(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """(domain, item, pos, claim, paper) with title and doi of the analysed paper (domain, ord, paper_id, title, doi) that the
    reference names: by id, title or normalised title as it stands, else after it is normalised. Of several papers the last
    counts; references that name none stay, with empty fields."""
    keys = papers.select("domain", "ord", "title", "doi", F.explode(F.array_distinct(F.array("paper_id", "title", normalize_title(F.col("title"))))).alias("key")).where("key <> ''")
    keys = keys.groupBy("domain", "key").agg(F.max(F.struct("ord", "title", "doi")).alias("p"))
    rows = claims.withColumn("key", F.col("paper")).join(keys, ["domain", "key"], "left").withColumnRenamed("p", "_exact")
    rows = rows.withColumn("key", normalize_title(F.col("paper"))).join(keys, ["domain", "key"], "left")
    found = F.coalesce("_exact", "p")
    return rows.select("domain", "item", "pos", "claim", "paper", F.coalesce(found["title"], F.lit("")).alias("title"), F.coalesce(found["doi"], F.lit("")).alias("doi"))


def recommended_reading(recommendations: DataFrame, most: int = 12) -> DataFrame:
    """Reviews first, then classics, then recent papers of promise, each title once, the first ``most``: place, title."""
    order = F.when(F.col("recommendation_type") == "review_entry", 0).when(F.col("recommendation_type") == "classic", 1).when(F.col("recommendation_type") == "recent_high_potential", 2)
    rows = recommendations.withColumn("_list", order).where(F.col("_list").isNotNull() & (F.col("title") != ""))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_list").orderBy("rank"))).where(F.col("_nth") <= most)
    first = rows.groupBy("title").agg(F.min(F.struct("_list", "rank")).alias("o")).orderBy("o").limit(most)
    return first.select(F.row_number().over(Window.orderBy("o")).alias("place"), "title")


def source_paper_index(papers: DataFrame, each: int = 3, most: int = 30) -> DataFrame:
    """The first papers of every domain (domain, ord, title, doi), each DOI (else title) once over all domains, in order."""
    w = Window.partitionBy("domain").orderBy("ord")
    rows = papers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).withColumn("_key", F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.nullif(F.col("title"), F.lit("")))).where("_key is not null")
    once = rows.groupBy("_key").agg(F.min_by(F.struct("title", "domain", "doi"), F.struct("domain", "ord")).alias("p"), F.min(F.struct("domain", "ord")).alias("o"))
    return once.orderBy("o").limit(most).select("p.title", "p.domain", "p.doi")


def cross_domain_tokens(domains: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent words of the domains' names, ties by word."""
    return domains.select(F.explode(tokens(F.col("domain_name"), least=4)).alias("token")).groupBy("token").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "token").limit(most)


def gaps(syntheses: DataFrame, most: int = 12) -> DataFrame:
    """The first research gaps over all domains (domain, gaps: array), in the order of domains."""
    return syntheses.select("domain", F.posexplode("gaps").alias("pos", "gap")).orderBy("domain", "pos").limit(most)


#: Headings of a domain's report, the field that each is made of, and what stands for nothing.
SECTIONS = (
    ("Core Problem System", "core_problem_system"), ("Method System", "method_system"), ("Mature Findings", "mature_findings"), ("Controversies Or Uncertainties", "controversies_or_uncertainties"),
    ("Research Gaps", "research_gaps"), ("Candidate Research Questions", "candidate_research_questions"),
)
NOTHING = "- Not enough evidence in the prepared inputs."


def bullets(values: Column) -> Column:
    """A list as Markdown."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), F.coalesce(v, F.lit("")))), "\n")).otherwise(NOTHING)


def count_line(name: Column, papers: Column, citations: Column) -> Column:
    return F.format_string("%s (%d papers; %d citations)", F.coalesce(name, F.lit("Unknown")), papers.cast("long"), citations.cast("long"))


def reliability_note(reliability: Column, full_text: Column, selected: Column) -> Column:
    sparse = F.format_string("The domain synthesis has sparse full-text PDF support (%d of %d selected papers) and should be treated as provisional.", full_text.cast("long"), selected.cast("long"))
    partial = "The domain synthesis has partial full-text support; method and limitation claims should be read with some caution."
    return F.when(reliability == "high", "The domain synthesis is supported by broad full-text PDF evidence among the selected papers.").when(reliability == "medium", partial).otherwise(sparse)


def domain_report(synthesis: Column, coverage: dict[str, Column] | None = None, note: Column | None = None) -> Column:
    """A repaired synthesis (struct) as Markdown, with the coverage's labels and values and its note if there are any."""
    head = [F.concat(F.lit("# "), F.coalesce(F.nullif(synthesis["domain"], F.lit("")), F.lit("Domain"))), F.lit(""), synthesis["one_sentence_summary"], F.lit("")]
    if coverage:
        head += [F.lit("## Evidence Coverage"), F.lit(""), *(F.concat(F.lit(f"- {label}: "), value.cast("string")) for label, value in coverage.items())]
        head += [F.lit(""), F.concat(F.lit("Reliability note: "), note)] if note is not None else []
        head.append(F.lit(""))
    for title, name in SECTIONS:
        head += [F.lit(f"## {title}"), F.lit(""), bullets(synthesis[name]), F.lit("")]
    reading = F.transform(synthesis["recommended_reading_order"], lambda x: F.rtrim(F.concat(F.coalesce(F.get_json_object(x, "$.title"), F.lit("")), F.lit(": "), F.coalesce(F.get_json_object(x, "$.reason"), F.lit("")))))
    tail = [F.lit("## Recommended Reading Order"), F.lit(""), bullets(reading), F.lit(""), F.concat(F.lit("Confidence: "), synthesis["confidence"]), F.lit("")]
    return F.array_join(F.array(*head, *tail), "\n")
