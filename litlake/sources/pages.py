"""HTML pages: visible text, citation metadata, links of listings."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Elements whose content isn't text.
HIDDEN = ("script", "style", "nav", "header", "footer", "aside", "noscript")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def visible_text(page: Column) -> Column:
    """The page without comments, hidden elements and tags, white space collapsed: expressions only."""
    out = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", " ")
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(page, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def links(page: Column) -> Column:
    """Targets of all anchors, first occurrences in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)))


def article_links(page: Column, prefix: str) -> Column:
    """Links to articles: those that begin with the prefix, without PDF twins, query and fragment."""
    clean = F.transform(links(page), lambda u: F.regexp_replace(u, "[?#].*$", ""))
    return F.array_distinct(F.filter(clean, lambda u: F.startswith(u, F.lit(prefix)) & ~F.endswith(u, F.lit(".pdf"))))


def next_link(page: Column) -> Column:
    """The target of the first anchor whose text or rel says next."""
    return F.regexp_extract(F.coalesce(page, F.lit("")), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>\s*(?:next(?:\s+page)?|›|»)\s*(?:<|$)""", 1)


class _Meta(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := (at.get("name") or at.get("property", "")).lower()):
            self.found.setdefault(name, []).append(html.unescape(at.get("content", "")).strip())


def parse_meta(page: str | None) -> tuple[str, str, str, str, str, str, list[str], list[str]]:
    """(title, doi, journal, date, abstract, pdf_url, authors, institutions) from meta elements, with fall-backs."""
    p = _Meta()
    p.feed(page or "")
    first = lambda *names: next((v for n in names for v in p.found.get(n, []) if v), "")
    lists = lambda n: list(dict.fromkeys(v for v in p.found.get(n, []) if v))
    head = first("citation_title", "dc.title", "og:title")
    if not head and (m := re.search(r"(?is)<title[^>]*>(.*?)</title>", page or "")):
        head = html.unescape(re.sub(r"\s+", " ", m[1])).strip()
    doi = re.sub(r"(?i)^(doi:|https?://(dx\.)?doi\.org/)", "", first("citation_doi", "dc.identifier", "prism.doi"))
    return head, doi, first("citation_journal_title", "prism.publicationname"), first("citation_online_date", "citation_publication_date", "dc.date"), first("citation_abstract", "dc.description", "description", "og:description"), first("citation_pdf_url"), lists("citation_author"), lists("citation_author_institution")


def page_meta(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url and the fields of an article."""
    names = ["title", "doi", "journal", "publish_date", "abstract", "pdf_url", "authors", "institutions"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["page_id", "url"]], pd.DataFrame([parse_meta(x) for x in b["html"]], columns=names, index=b.index)], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, doi string, journal string, publish_date string, abstract string, pdf_url string, authors array<string>, institutions array<string>")
