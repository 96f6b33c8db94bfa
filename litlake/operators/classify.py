"""Papers assigned to domains: by ranked evidence, by rules, by clusters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import rule_confidence
from ..functions.text import PAPER_STOPWORDS, count_term, tokens
from ..tables import cut
from . import linkage

UNCLASSIFIED = "未分类"
#: Sources and taxonomies of evidence, the preferred first, and the confidence of a Crossref subject.
SOURCE_ORDER = ("pubmed_mesh", "openalex", "crossref", "local_rule")
TAXONOMY_ORDER = ("MeSH", "topic", "concept", "subject", "rule")
SUBJECT_CONFIDENCE = 0.72


def _order(x: Column, values: Sequence[str]) -> Column:
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(x == v, i).otherwise(out)
    return out


def best_evidence(evidence: DataFrame) -> DataFrame:
    """(id, pos, source, taxonomy, label, domain, confidence) -> of each id the row with a domain that comes first by source,
    taxonomy, confidence, place."""
    w = Window.partitionBy("id").orderBy(_order(F.col("source"), SOURCE_ORDER), _order(F.col("taxonomy"), TAXONOMY_ORDER), F.desc("confidence"), "pos")
    return evidence.where("domain <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rule_classify(articles: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Domain, matched terms and confidence of every article: a term counts once in the whole text and four times more in the
    title; the best rule wins, ties by name. The rules are few, so all are scored in one projection, without a join."""
    title = F.lower(F.col("title"))
    text = F.lower(F.concat_ws(" ", "title", "abstract", "article_type", "journal"))
    terms = sorted({t for _, ts in rules for t in ts})
    # plain words are found by one pattern, as each word of a text can be one of them only; then they are counted
    plain = sorted({t.lower() for t in terms if re.fullmatch("[a-z0-9]+", t.lower())})
    words = F.lit(f"(?<![a-z0-9])(?:{'|'.join(plain)})(?![a-z0-9])")
    found = lambda x: F.regexp_extract_all(x, words, F.lit(0)) if plain else F.array().cast("array<string>")
    rows = articles.withColumns({"_title": title, "_text": text}).withColumns({"_in_title": found(F.col("_title")), "_in_text": found(F.col("_text"))})

    def counts(part: str) -> Column:
        one = lambda t: F.size(F.filter(f"_in_{part}", lambda x: x == t.lower())) if t.lower() in plain else count_term(F.col(f"_{part}"), t)
        return F.array(*[one(t) for t in terms])

    rows = rows.withColumns({"_n": counts("text"), "_m": counts("title")})
    at = {t: i for i, t in enumerate(terms)}
    scores = []
    for domain, of in sorted(rules):
        score = sum((4 * F.get("_m", F.lit(at[t])) + F.get("_n", F.lit(at[t])) for t in of), F.lit(0))
        matched = F.slice(F.filter(F.array(*[F.when(F.get("_n", F.lit(at[t])) > 0, t) for t in of]), lambda x: x.isNotNull()), 1, 5)
        scores.append(F.struct((-score).alias("less"), F.lit(domain).alias("domain"), matched.alias("terms")))
    best = rows.withColumn("_best", F.array_min(F.array(*scores)))
    hit = F.col("_best.less") < 0
    return best.withColumns(
        {
            "domain": F.when(hit, F.col("_best.domain")).otherwise(UNCLASSIFIED),
            "matched_terms": F.when(hit, F.array_join("_best.terms", ", ")).otherwise(""),
            "confidence": F.when(hit, rule_confidence(-F.col("_best.less"))).otherwise(F.lit(0.0)),
        }
    ).drop("_title", "_text", "_in_title", "_in_text", "_n", "_m", "_best")


def article_keywords(rows: DataFrame, most: int = 5) -> DataFrame:
    """(id, text) -> id, rank, token, count: the tokens of four characters or more that each text has most, ties by first
    appearance."""
    rows = rows.select("id", "text").repartition("id")  # texts move once, tokens never
    t = rows.select("id", F.posexplode(tokens(F.col("text"), PAPER_STOPWORDS, 4)).alias("pos", "token"))
    counts = t.groupBy("id", "token").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("count"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("first")


def taxonomy_mode(evidence: DataFrame) -> DataFrame:
    """The most frequent source of each domain, ties by name."""
    counts = evidence.groupBy("domain", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("domain").orderBy(F.desc("n"), "source")
    return counts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("domain", "source", "n")


def authoritative(articles: DataFrame, providers: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``articles`` (with id) classified: topics on the record as evidence if there are any, even ones that yield nothing; else
    the providers' rows (id, provider, pos, ...), of which the first provider with a domain counts; else rules; else
    unclassified. Rows with an error keep confidence 0."""
    own = articles.select("id", F.posexplode("authoritative_topics").alias("pos", "t")).select("id", "pos", "t.source", "t.taxonomy", "t.label", F.coalesce("t.field", F.lit("")).alias("domain"), F.coalesce("t.score", F.lit(0.0)).alias("confidence"))
    asked = articles.where(F.size("authoritative_topics") == 0).select("id")
    w = Window.partitionBy("id")
    given = providers.join(asked, "id", "left_semi").where("domain <> ''").withColumn("_first", F.min("provider").over(w)).where("provider = _first")
    best = best_evidence(own.unionByName(given.select(own.columns)))
    ruled = rule_classify(articles, rules)
    out = ruled.join(best.select("id", F.col("source").alias("_source"), F.col("domain").alias("_domain"), F.col("confidence").alias("_confidence")), "id", "left")
    local = (F.col("domain") != UNCLASSIFIED)
    return out.withColumns({
        "classification_source": F.coalesce("_source", F.when(local, "local_rule").otherwise("none")),
        "subdomain": F.coalesce("_domain", "domain"),
        "classification_confidence": F.coalesce("_confidence", "confidence"),
    }).drop("_source", "_domain", "_confidence", "domain", "confidence", "matched_terms")


#: Words that are no keyword of a cluster, and none of its label.
CLUSTER_STOPWORDS = ("this", "that", "with", "from", "paper", "study", "article")
LABEL_STOPWORDS = (
    "paper", "study", "article", "research", "using", "shows", "reveals", "science", "nature", "aging", "ageing", "cell", "cells", "human",
    "from", "with", "this", "that", "into", "both", "disease", "journal",
)


def cluster_keywords(rows: DataFrame, most: int = 12) -> DataFrame:
    """(cluster, id, text) -> (cluster, rank, token): the most frequent words of every cluster, ties in order of appearance."""
    t = rows.select("cluster", "id", F.posexplode(tokens(F.col("text"), CLUSTER_STOPWORDS, 4)).alias("pos", "token"))
    counts = t.groupBy("cluster", "token").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cluster", "rank", "token")


def label_of(words: Column) -> Column:
    """Topic_A_B_C from the first three keywords that are long enough and say something; else Topic_Other."""
    plain = F.transform(words, lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    useful = F.slice(F.array_distinct(F.filter(plain, lambda t: (F.length(t) >= 4) & ~t.isin(*LABEL_STOPWORDS))), 1, 3)
    upper = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("[a-z]+|[^a-z]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.when(F.size(useful) > 0, F.concat(F.lit("Topic_"), F.array_join(F.transform(useful, upper), "_"))).otherwise("Topic_Other")


def cluster_labels(rows: DataFrame, votes: str | None = None, least: int = 2) -> DataFrame:
    """(cluster, id, text) -> (cluster, papers, keywords, label, confidence). The label comes from the keywords; or, with the
    column ``votes``, is the most frequent subdomain but "Other", ties by name, where there is one. Clusters of less than
    ``least`` papers have the confidence of a single topic."""
    words = cluster_keywords(rows).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    out = rows.groupBy("cluster").agg(F.count("*").alias("papers")).join(words, "cluster", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    label = label_of(F.col("keywords"))
    if votes:
        named = rows.where(F.col(votes).isNotNull() & ~F.col(votes).isin("", "Other")).groupBy("cluster", votes).agg(F.count("*").alias("n"))
        best = named.groupBy("cluster").agg(F.min_by(votes, F.struct(-F.col("n"), F.col(votes))).alias("_vote"))
        out = out.join(best, "cluster", "left")
        label = F.coalesce("_vote", label)
    alone = F.when(label == "Topic_Other", 0.0).otherwise(0.55)
    sure = F.round(F.least(F.lit(0.95), 0.68 + 0.05 * F.col("papers")), 3)
    return out.withColumns({"label": label, "confidence": F.when(F.col("papers") < least, alone).otherwise(sure)}).drop("_vote")


def classify_batch(rows: DataFrame, by: str, votes: str | None = None, least: int = 2) -> DataFrame:
    """(by, id, text, v) -> (by, id, cluster, subdomain, confidence, reason): every collection ``by`` clustered by its vectors,
    every paper named after its cluster.

    A cluster's label comes from its keywords or, with ``votes``, its most frequent subdomain (``cluster_labels``). A paper
    alone in its cluster, and all of a collection with fewer than ``least`` papers or texts, are named by their own keywords,
    and the reason says so; cluster is null where nothing was clustered. A null text has no keyword, a paper without a vector
    is in no cluster. Ids are unique."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(by, F.col("id").cast("long").alias("id"), text.alias("text"), "v", *([votes] if votes else []))
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"), F.count_if(F.trim("text") != "").alias("_t"))
    enough = (F.col("_n") >= least) & (F.col("_t") >= least)
    clustered = linkage.clusters(rows.join(sizes.where(enough), by, "left_semi"), by)
    placed = cut(rows.join(sizes, by).join(clustered.select("id", "cluster"), "id", "left").withColumn("_members", F.count("cluster").over(Window.partitionBy(by, "cluster"))).drop("v"), "placed")
    together = F.col("cluster").isNotNull() & (F.col("_members") >= least)
    # a cluster, or a paper by itself
    key = F.when(together, F.struct(F.col(by).cast("string").alias("by"), F.col("cluster").alias("c"), F.lit(None).cast("long").alias("id"))).otherwise(F.struct(F.lit(None).cast("string").alias("by"), F.lit(None).cast("int").alias("c"), F.col("id").alias("id")))
    keyed = placed.withColumn("_key", key)
    labels = cluster_labels(keyed.select(F.col("_key").alias("cluster"), "id", "text", *([votes] if votes else [])), votes, least)
    labels = labels.select(F.col("cluster").alias("_key"), F.col("label").alias("subdomain"), "confidence", F.array_join(F.slice("keywords", 1, 8), ", ").alias("_words"))
    null_safe = keyed.alias("k").join(labels.alias("l"), F.col("k._key").eqNullSafe(F.col("l._key")))
    why = (
        F.when(together, F.concat(F.lit("auto_cluster="), "cluster", F.lit("; keywords: "), "_words"))
        .when(F.col("cluster").isNotNull(), F.concat(F.lit("cluster="), "cluster", F.lit("; singleton topic")))
        .when(F.col("_n") < least, "insufficient records for clustering")
        .when(F.col("_t") < least, "insufficient article text for clustering")
        .otherwise("no vector")
    )
    return null_safe.select(F.col(f"k.{by}").alias(by), "id", "cluster", "subdomain", "confidence", why.alias("reason"))
