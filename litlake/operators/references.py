"""Cited works: pooled over papers, merged, scored; and found in raw text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import TIERS, reference_value
from ..functions.text import cosine, dedupe, reference_key, token_set
from ..schema import REFERENCE

#: Words that don't count in relevance, against a profile and against the citing paper.
PROFILE_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "using", "study", "paper", "article", "research",
    "analysis", "nature",
)
SOURCE_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "using", "both", "only", "paper", "study", "article",
    "analysis", "research", "method", "methods", "result", "results", "a", "an", "of", "in", "to", "on", "by", "as",
    "is", "are", "via", "or",
)


def unnest(articles: DataFrame) -> DataFrame:
    """A row for each reference: article's _ord, doi and title as source_*, pos, and the reference's fields."""
    rows = articles.select("_ord", F.col("doi").alias("source_doi"), F.col("title").alias("source_title"), F.posexplode("references").alias("pos", "r"))
    return rows.select("_ord", "pos", "source_doi", "source_title", "r.*")


def capped(refs: DataFrame, per_paper: int | None = 50, total: int | None = 1000) -> DataFrame:
    """The first ``per_paper`` of every paper, of these the first ``total``; the total counts rows without a key and repeats."""
    if per_paper is not None:
        w = Window.partitionBy("_ord").orderBy("pos")
        refs = refs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_paper).drop("_n")
    return refs if total is None else refs.orderBy("_ord", "pos").limit(total)


def pool(refs: DataFrame) -> DataFrame:
    """One row for each key (DOI, else title): of each text field the first that isn't empty, of others the first row's, and
    distinct source titles and DOIs."""
    ord_ = F.struct("_ord", "pos")
    key = reference_key(F.col("doi"), F.col("title"))
    text = ["title", "doi", "journal", "publish_date", "abstract", "pdf_url"]
    first = [F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", ord_)).alias(f"_{c}") for c in text]
    authors = F.min_by(F.when(F.size("authors") > 0, F.col("authors")), F.when(F.size("authors") > 0, ord_)).alias("_authors")
    sources = F.array_sort(F.collect_list(F.struct("_ord", "pos", "source_title", "source_doi"))).alias("_s")
    rows = refs.where(key != "").groupBy(key.alias("ref_key")).agg(*first, authors, F.min_by("citation_count", ord_).alias("citation_count"), F.min(ord_).alias("_first"), sources)
    titles, dois = dedupe(F.col("_s.source_title")), dedupe(F.col("_s.source_doi"))
    return rows.select(
        "ref_key", *[F.coalesce(f"_{c}", F.lit("")).alias(c) for c in text], F.coalesce("_authors", F.array().cast("array<string>")).alias("authors"), "citation_count",
        titles.alias("source_article_titles"), dois.alias("source_article_dois"), F.greatest(F.size(titles), F.lit(1)).alias("source_article_count"), "_first",
    )


def insights(refs: DataFrame, most: int = 20) -> DataFrame:
    """References of all papers by key: largest counts and scores, first texts, the titles that cite them."""
    ord_ = F.struct("_ord", "pos")
    rows = refs.where(reference_key(F.col("doi"), F.col("title")) != "").groupBy(reference_key(F.col("doi"), F.col("title")).alias("ref_key")).agg(
        *[F.min_by(c, ord_).alias(c) for c in ("title", "doi", "journal", "publish_date")],
        F.max(F.coalesce("citation_count", F.lit(0))).alias("citation_count"), F.max("source_article_count").alias("source_article_count"), F.max("relevance_score").alias("relevance_score"), F.max("value_score").alias("value_score"),
    )
    return rows.orderBy(F.desc("value_score"), F.desc("relevance_score"), F.desc("source_article_count"), F.desc("citation_count"), F.lower("title"), "ref_key").limit(most)


def overlap(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def profile_relevance(profile: Column, reference: Column) -> Column:
    """Shared words over the smaller set of words; 0 if either is empty."""
    a, b = token_set(profile, PROFILE_STOPWORDS), token_set(reference, PROFILE_STOPWORDS)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.least(F.lit(1.0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))), 3)).otherwise(F.lit(0.0))


#: What reasons say.
NO_TEXT, NO_TERMS, TERMS_SHARED, BY_VECTOR = "missing profile/reference text", "no shared terms", "shared terms: ", "embedding cosine similarity"


def profile_of(articles: DataFrame, most: int = 20_000) -> DataFrame:
    """One row (profile): the first ``most`` characters of titles, abstracts, subdomains, problems and solutions, papers in the
    order of ``_ord``. Papers are looked at from the first on, four times as many each time, until their texts are enough."""
    parts = F.filter(F.array("title", "abstract", "subdomain", "problem_statement", F.coalesce("solution_summary", F.lit(""))), lambda x: x != "")
    texts = articles.select("_ord", F.substring(F.array_join(parts, " "), 1, most).alias("t")).where("t <> ''")
    n, whole = 64, texts.count()
    while True:
        first = texts.orderBy("_ord").limit(n)
        one = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "t"))), lambda x: x["t"]), " ").alias("profile"))
        if n >= whole or first.agg(F.sum(F.length("t") + 1)).first()[0] > most:
            return one.select(F.substring("profile", 1, most).alias("profile"))
        n *= 4


def against_profile(refs: DataFrame, profile: DataFrame, vectors: bool = False) -> DataFrame:
    """References (title, abstract, journal, authors; with ``vectors`` also v) against the one row of ``profile`` (profile;
    profile_v): relevance_score and relevance_reason. By the cosine of the vectors where both sides have one and a text, else by
    shared words over the smaller set of words, of which the reason names ten."""
    text = F.concat_ws(" ", "title", "abstract", "journal", F.array_join("authors", " "))
    one = profile.select(token_set(F.col("profile"), PROFILE_STOPWORDS).alias("_p"), (F.trim("profile") != "").alias("_any"), *([F.col("profile_v").alias("_pv")] if vectors else []))
    rows = refs.withColumns({"_text": text, "_r": token_set(text, PROFILE_STOPWORDS)}).crossJoin(F.broadcast(one))  # one row
    rows = rows.withColumn("_o", overlap(F.col("_p"), F.col("_r")))
    score = F.when((F.size("_p") > 0) & (F.size("_r") > 0), F.round(F.least(F.lit(1.0), F.size("_o") / F.least(F.size("_p"), F.size("_r"))), 3)).otherwise(F.lit(0.0))
    reason = F.when((F.size("_p") == 0) | (F.size("_r") == 0), NO_TEXT).when(F.size("_o") == 0, NO_TERMS).otherwise(F.concat(F.lit(TERMS_SHARED), F.array_join(F.slice("_o", 1, 10), ", ")))
    if vectors:
        near = F.col("v").isNotNull() & F.col("_pv").isNotNull() & F.col("_any") & (F.trim("_text") != "")
        score, reason = F.when(near, F.round(cosine(F.col("v"), F.col("_pv")), 3)).otherwise(score), F.when(near, BY_VECTOR).otherwise(reason)
    return rows.withColumns({"relevance_score": score, "relevance_reason": reason}).drop("_text", "_r", "_p", "_any", "_pv", "_o")


def source_relevance(source: Column, reference: Column) -> Column:
    """As ``profile_relevance`` with other stop words, and up to 0.08 more for shared words."""
    a, b = token_set(source, SOURCE_STOPWORDS), token_set(reference, SOURCE_STOPWORDS)
    n = F.size(F.array_intersect(a, b))
    score = F.least(F.lit(1.0), n / F.least(F.size(a), F.size(b)) + F.least(F.lit(0.08), 0.02 * n))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(score, 3)).otherwise(F.lit(0.0))


def relevance_pairs(queries: DataFrame, docs: DataFrame, stopwords: Sequence[str], bonus: bool = False) -> DataFrame:
    """(query_id, text) against all (doc_id, text): the relevance of every pair that shares a word, as ``profile_relevance`` or, with
    ``bonus``, ``source_relevance`` would give it. Words are made once for each text; the pairs meet by word, and their shared
    words are counted map-side, so a text's words are never repeated for each query."""

    def words(rows: DataFrame, key: str, size: str) -> DataFrame:
        rows = rows.select(key, token_set(F.col("text"), stopwords).alias("w"))
        return rows.select(key, F.size("w").alias(size), F.explode("w").alias("word"))

    shared = words(docs, "doc_id", "y").join(words(queries, "query_id", "x"), "word").groupBy("query_id", "doc_id", "x", "y").agg(F.count("*").alias("n"))
    score = F.col("n") / F.least("x", "y") + (F.least(F.lit(0.08), 0.02 * F.col("n")) if bonus else F.lit(0.0))
    return shared.select("query_id", "doc_id", F.round(F.least(F.lit(1.0), score), 3).alias("relevance"))


def scored(pooled: DataFrame, as_of_year: int, tiers: Sequence[tuple[str, str, float]] = TIERS) -> DataFrame:
    """A pool with relevance_score gets value_score, journal_tier and journal_tier_score."""
    most = pooled.agg(F.coalesce(F.max("citation_count"), F.lit(0)).alias("_most"))
    value, tier, tier_score = reference_value(F.col("_most"), as_of_year, tiers)
    return pooled.crossJoin(F.broadcast(most)).withColumns({"value_score": value, "journal_tier": tier, "journal_tier_score": tier_score}).drop("_most")


def best_by_key(refs: DataFrame, threshold: float = 0.12) -> DataFrame:
    """Of every key the reference with the highest relevance, the earliest of equals, if it reaches the threshold."""
    w = Window.partitionBy(reference_key(F.col("doi"), F.col("title"))).orderBy(F.desc("relevance_score"), "_ord", "pos")
    rows = refs.where((F.col("relevance_score") >= threshold) & (reference_key(F.col("doi"), F.col("title")) != ""))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Lines that open a reference section, and lines that close it.
OPENING = r"(?im)^[ \t]*(?:references|bibliography)[ \t]*:?[ \t]*$"
CLOSING = r"(?im)^[ \t]*(?:acknowledg\w*|appendix.*|supplementary.*|author contributions.*|competing interests.*|extended data.*)[ \t]*$"


def reference_section(text: Column) -> Column:
    """What follows the last opening line, up to a closing one; "" without an opening line."""
    parts = F.split(F.coalesce(text, F.lit("")), OPENING, -1)
    return F.when(F.size(parts) > 1, F.trim(F.get(F.split(F.element_at(parts, -1), CLOSING, -1), F.lit(0)))).otherwise("")


def split_references(section: Column) -> Column:
    """By numbers (``1.`` or ``[1]``) at the start of lines; without any, by blank lines. White space is collapsed."""
    numbered = F.split(section, r"(?m)^\s*(?:\d+\.|\[\d+\])\s+", -1)
    parts = F.when(F.size(numbered) > 1, F.slice(numbered, 2, F.size(numbered) - 1)).otherwise(F.split(section, r"\n\s*\n", -1))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


#: A DOI; a year.
_DOI, _YEAR = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", r"\b(?:19|20)\d{2}\b"


def _is_initial(word: str) -> bool:
    """Whether a word's full stop belongs to a single capital: "J.", "A.B.", "(K."."""
    return word.endswith(".") and "A" <= word[-2:-1] <= "Z" and not word[-3:-2].isalnum()


def clauses(raw: str) -> list[str]:
    """The words up to each one that ends in a full stop, question or exclamation mark. An initial ends a clause only where a
    sentence seems to begin: a capitalised word with two more behind it."""
    words, out, begin = raw.split(), [], 0
    for i, word in enumerate(words):
        ends = word[-1] in ".?!"
        if ends and _is_initial(word):
            ahead = words[i + 1 : i + 4]
            ends = len(ahead) == 3 and ahead[0].isalpha() and ahead[0].istitle()
        if ends or i == len(words) - 1:
            out.append(" ".join(words[begin : i + 1]))
            begin = i + 1
    return [c for c in (c.strip(" ;") for c in out) if c.strip(".")]


def journal_of(tail: str) -> str:
    """The words that a text begins with, from a capital on, as far as they are letters, ``&``, ``-`` or full stops."""
    name: list[str] = []
    for word in tail.split():
        if not name:
            word = word.lstrip("0123456789.,;:()[]\"'-")
            if not word:
                continue
            if not "A" <= word[0] <= "Z":
                break
        part = "".join(takewhile(lambda c: c.isascii() and c.isalpha() or c in "&.-", word))
        if part:
            name.append(part)
        if part != word:
            break
    return " ".join(name).strip(" .-&")


def title_and_journal(raw: str, year: str) -> tuple[str, str]:
    """The first clause of three words or more behind the authors is the title, the journal is what the next ones begin with,
    before the year. A first clause is taken for authors if it has a comma, an ampersand, "et al" or an initial."""
    parts = clauses(raw)
    named = len(parts) > 1 and (any(x in parts[0] for x in (",", "&", " et al")) or any(map(_is_initial, parts[0].split())))
    rest = parts[1:] if named else parts
    if not rest:
        return "", ""
    place = next((i for i, p in enumerate(rest) if len(p.split()) >= 3), 0)
    tail = " ".join(rest[place + 1 :])
    return rest[place].strip(" ."), journal_of(tail.partition(year)[0] if year else tail)


def extract_references(texts: DataFrame, most: int | None = None) -> DataFrame:
    """(id, text) -> id, pos, raw, title, doi, publish_date, journal, authors: each text's references, of equal keys the one
    with most fields, the earliest of equals. Sections are found by expressions; only single references go to Python."""
    rows = texts.select("id", F.posexplode(split_references(reference_section(F.col("text")))).alias("pos", "raw"))
    rows = rows if most is None else rows.where(F.col("pos") < most)
    # what patterns say is an expression: DOI, year, the names in front of the first full stop
    raw = F.col("raw")
    head = F.get(F.split(raw, r"\.\s", 2), F.lit(0))
    names = F.slice(F.filter(F.transform(F.split(head, r"[,;]\s+"), lambda a: F.trim(a)), lambda a: a != ""), 1, 8)
    rows = rows.select(
        "id", "pos", "raw", F.lower(F.regexp_replace(F.regexp_extract(raw, _DOI, 0), r"[.,;)]+$", "")).alias("doi"), F.regexp_extract(raw, _YEAR, 0).alias("publish_date"),
        F.when(F.length(head) <= 160, names).otherwise(F.array().cast("array<string>")).alias("authors"), F.trim(F.regexp_replace(F.regexp_replace(raw, r"https?://\S+", ""), f"{_DOI}|(?i)\\bdoi:?", "")).alias("_body"),
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([title_and_journal(r, y) for r, y in zip(b["_body"], b["publish_date"])], columns=["title", "journal"], index=b.index)
            yield pd.concat([b.drop(columns="_body"), found], axis=1)

    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInPandas(parse, f"id {kind}, pos int, raw string, doi string, publish_date string, authors array<string>, title string, journal string")
    quality = sum(((F.col(c) != "").cast("int") for c in ("title", "doi", "journal", "publish_date")), (F.size("authors") > 0).cast("int"))
    w = Window.partitionBy("id", reference_key(F.col("doi"), F.col("title"))).orderBy(F.desc(quality), "pos")
    return rows.where(reference_key(F.col("doi"), F.col("title")) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_extracted(articles: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """Articles (``schema.ARTICLE`` and id) with the references that their files' texts (id, text) end with. Those of a complete
    file replace what was there, even by none; other articles keep theirs. A text without an article is ignored."""
    readable = (F.col("pdf_status") == "complete") & (F.col("local_pdf_path") != "")
    found = extract_references(texts.join(articles.where(readable).select("id"), "id", "left_semi"), most)
    own = articles.select("id", F.col("doi").alias("source_article_doi"), F.col("title").alias("source_article_title"))
    found = found.join(own, "id").withColumn("source_article_count", F.lit(1))
    fields = [(F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in REFERENCE.fields]
    lists = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r"))), lambda a, b: a["pos"] - b["pos"]), lambda x: x["r"]).alias("_found"))
    rows = articles.join(lists, "id", "left")
    kind = articles.schema["references"].dataType
    return rows.withColumn("references", F.when(readable, F.coalesce(F.col("_found").cast(kind), F.array().cast(kind))).otherwise(F.col("references"))).drop("_found")


def title_search(hits: DataFrame, title: str | None, most: int) -> DataFrame:
    """Hits of several services (_ord in the order of services), repeats dropped; with a title by likeness to it, then
    citations, then title; else by citations and title. The first ``most``."""
    from .evidence import greedy_distinct, title_similarity

    rows = greedy_distinct(hits)
    order = [F.desc(F.coalesce("citation_count", F.lit(0))), F.lower("title"), F.col("_ord")]
    if title:
        rows = rows.withColumn("similarity", title_similarity(title))
        order = [F.desc("similarity"), *order]
    return rows.orderBy(*order).limit(most)


def downloadable(pool: DataFrame, threshold: float, least: float, most: int, need_doi: bool = True) -> DataFrame:
    """Of a scored pool with ``completed`` the references to ask for: relevant, valuable and with a DOI, the best first, until
    ``most`` are complete. Only the ones that are complete count, so the cut is the place of the last of these."""
    if most <= 0:
        return pool.limit(0)
    ok = (F.col("relevance_score") >= threshold) & (F.col("value_score") >= least)
    rows = pool.where(ok & (F.col("doi") != "") if need_doi else ok)
    place = F.struct(-F.col("value_score"), -F.col("relevance_score"), F.lower("title"), F.col("ref_key"))
    rows = rows.withColumn("_place", place)
    last = rows.where("completed").orderBy("_place").limit(most).agg(F.max("_place").alias("_last"), F.count("*").alias("_n"))  # one row
    return rows.crossJoin(F.broadcast(last)).where((F.col("_n") < most) | (F.col("_place") <= F.col("_last"))).drop("_place", "_last", "_n")
