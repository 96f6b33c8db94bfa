"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Words that are no keywords, for topics, for one paper, for reference and for source relevance.
TOPIC_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "using", "study", "paper", "article", "research",
    "analysis", "model", "models", "based", "data", "results", "here", "show", "over", "under", "between",
)
PAPER_STOPWORDS = (
    "this", "that", "with", "from", "paper", "study", "article", "research", "using", "based", "analysis", "method",
    "methods", "results", "shows", "journal", "science", "nature", "human", "humans",
)


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def extract_year(x: Column) -> Column:
    """The first 19xx or 20xx anywhere, as a string; "" without one."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), "(19|20)[0-9]{2}", 0)


def normalize(x: Column) -> Column:
    """Lower case, white space of any kind collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "), "^ | $", "")


def normalize_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(x: Column, stopwords: Sequence[str] = TOPIC_STOPWORDS, least: int = 3) -> Column:
    """ASCII words with a leading letter and at least ``least`` characters, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z][a-z0-9+-]{%d,}" % (least - 1)), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords))


def token_set(x: Column, stopwords: Sequence[str] = TOPIC_STOPWORDS, least: int = 3) -> Column:
    return F.array_distinct(tokens(x, stopwords, least))


def sentences(x: Column, cjk: bool = False) -> Column:
    """Parts after ``. ! ?`` and white space (with ``cjk`` also after full-width stops), trimmed, without blanks."""
    pattern = r"(?<=[.!?])\s+|(?<=[。！？])\s*" if cjk else r"(?<=[.!?])\s+"
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), pattern, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def first_sentence(x: Column) -> Column:
    """The first of ``sentences``, null without any. What comes before the first cut is never blank, so the rest isn't read."""
    return blank_to_null(F.regexp_replace(F.get(F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+", 2), F.lit(0)), r"^\s+|\s+$", ""))


def problem_statement(abstract: Column, title: Column) -> Column:
    return F.coalesce(first_sentence(abstract), title)


def solution_summary(abstract: Column) -> Column:
    """The last two sentences, or the only one; null without an abstract."""
    s = sentences(abstract)
    return F.when(F.size(s) >= 2, F.array_join(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2), " ")).when(F.size(s) == 1, F.get(s, F.lit(0)))


def count_term(text: Column, term: str) -> Column:
    """Occurrences in lower-cased ``text``: as a substring if the term has a space, hyphen or beta, else as a whole word."""
    term = term.lower()
    if any(c in term for c in " -β"):
        return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")
    return F.regexp_count(text, F.lit(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"))


def clean_doi(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", ""))


def clean_abstract(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def clean_text(x: Column) -> Column:
    """Words broken at a line end joined, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"-\s*\n\s*", ""), r"\s+", " "))


def inverted_abstract(index: Column) -> Column:
    """map<word, positions> as text in order of position, then word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def date_parts(parts: Column) -> Column:
    """[[y, m, d]] joined by slashes."""
    return F.coalesce(F.array_join(F.get(parts, F.lit(0)).cast("array<string>"), "/"), F.lit(""))


def split_authors(x: Column) -> Column:
    return dedupe(F.split(F.coalesce(x, F.lit("")), ";"), distinct=False)


def int_or_none(x: Column) -> Column:
    return x.try_cast("int")


def dedupe(xs: Column, distinct: bool = True) -> Column:
    """Trimmed, blanks dropped, first occurrences in order."""
    out = F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return F.array_distinct(out) if distinct else out


def identity_key(doi: Column, url: Column, title: Column) -> Column:
    return F.when(F.trim(doi) != "", F.concat(F.lit("doi:"), F.lower(clean_doi(doi)))).when(F.trim(url) != "", F.concat(F.lit("url:"), F.lower(F.trim(url)))).otherwise(F.concat(F.lit("title:"), normalize(title)))


def reference_key(doi: Column, title: Column) -> Column:
    return F.coalesce(blank_to_null(F.lower(F.trim(F.coalesce(doi, F.lit(""))))), F.lower(F.trim(F.coalesce(title, F.lit("")))))


def journal_abbreviation(x: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.upper(F.substring(w, 1, 1))), "")


def last_segment(x: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(x, F.lit("")), ">"), -1))


def cut_cell(x: Column, most: int = 180) -> Column:
    """A Markdown table's cell: bars and line ends become spaces, long text ends in dots."""
    v = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[|\s]+", " "))
    return F.when(F.length(v) > most, F.concat(F.rtrim(F.substring(v, 1, most - 3)), F.lit("..."))).otherwise(v)


def strip_code_fence(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(x), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; 0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def first_field(body: Column, name: str, depth: int = 6) -> Column:
    """The first text under a name in a JSON text: of the object itself, else of what its values hold, up to ``depth`` levels."""

    def find(v: Column, left: int) -> Column:
        own = F.try_variant_get(v, f"$['{name}']", "string")
        if not left:
            return own
        values = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        below = F.filter(F.transform(values, lambda x: find(x, left - 1)), lambda s: s.isNotNull() & (s != ""))
        return F.coalesce(own, F.get(below, F.lit(0)))

    return F.coalesce(find(F.try_parse_json(F.coalesce(body, F.lit(""))), depth), F.lit(""))


def is_next_link(anchor: Column) -> Column:
    """Whether an anchor tag leads to a next page: by its relation, or by what it, its label or its title says."""
    low = F.lower(F.coalesce(anchor, F.lit("")))
    says = F.regexp_replace(F.concat_ws(" ", F.regexp_replace(low, "<[^>]*>", " "), F.regexp_extract(low, r"aria-label\s*=\s*[\"']([^\"']*)", 1), F.regexp_extract(low, r"title\s*=\s*[\"']([^\"']*)", 1)), r"\s+", " ")
    return low.rlike(r"\brel\s*=\s*[\"'][^\"']*\bnext\b") | F.contains(says, F.lit("next page")) | (F.trim(says) == "next")


def is_listing_url(url: Column, host: str, path: str) -> Column:
    """Whether an address is a page of a listing: relative or of ``host``, with the listing's path and a page number."""
    own = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).isin("", host)
    place = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), "/+$", "")
    return own & (place == path.rstrip("/")) & F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1).contains("page=")
