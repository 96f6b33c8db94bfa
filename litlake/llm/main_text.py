"""Main text of web pages: every page scores its containers, each host votes on their tag-class paths, winners are read again."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..tables import cut
from ._shared import text_chunks

#: Winning paths that a host keeps. A page that has none of them is read by its own best container, as if it were a host of its own.
PATHS = 32
#: Parts that a host's few winners are repeated for, so that a host's many pages are joined in as many.
SALTS = 16
#: Open elements that are looked through for one that a tag ends.
NEAR = 12

# The elements of HTML by what they do here.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article.
DROPPED = frozenset("head nav footer aside form dialog menu button select option datalist fieldset label template noscript svg object canvas video audio map".split())
#: Elements whose end and begin part blocks.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr li main menu nav ol optgroup option p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
#: Blocks that hold running text; text elsewhere is bare.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption td th caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body article main div section center td details figure search header".split())
#: A begun element ends these, if they are open inside the nearest of the others.
IMPLIED = {
    **{t: (frozenset(["p"]), frozenset("button td th caption table".split())) for t in BLOCKS - frozenset("html body head caption colgroup thead tbody tfoot tr td th option optgroup".split())},
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir".split())),
    **{t: (frozenset("dt dd p".split()), frozenset(["dl"])) for t in ("dt", "dd")},
    **{t: (frozenset("td th tr caption p".split()), frozenset(["table"])) for t in ("tr", "thead", "tbody", "tfoot")},
    **{t: (frozenset("td th caption p".split()), frozenset("table tr".split())) for t in ("td", "th")},
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id: readers' words (always furniture), other furniture, and what an article's own parts are called.
READERS = frozenset("comment comments commentlist respond disqus replies discussion".split())
FURNITURE = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead banner topbar header footer sidebar aside ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager skip toolbar search searchbox paywall disclaimer alert".split()
)
OWN = frozenset("article content post entry story main body text page".split())
TITLED = OWN - frozenset("main body text page".split())
#: Furniture that is none if the name says what of an article it is.
MILD = frozenset("header notice alert widget".split())
WITHOUT = frozenset("no with has without hide show not".split())

_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?|(/?)([a-zA-Z][^\s/><"']*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|(?=<)|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|\Z)""", re.I)
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+|(?<![a-z])[0-9a-f]{6,}(?![a-z])")


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    parent: int  # the container around it
    container: int  # itself, if it is one
    junk: int  # 0: no, 1: by its class, 2: for good
    article: bool
    inline: Counter = field(default_factory=Counter)


@dataclass(slots=True)
class Container:
    path: str
    parent: int
    own: bool  # an article by its tag or class
    chars: int = 0
    direct: int = 0
    bare: int = 0
    links: int = 0
    score: float = 0.0


@dataclass(slots=True)
class Block:
    text: str
    container: int
    kind: str
    links: int


def _names(attributes: dict[str, str]) -> list[str]:
    return [*attributes.get("class", "").split(), *attributes.get("id", "").split()]


def label(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its classes, or its id if there are none; numbers in them are wildcards."""
    names = attributes.get("class", "").split() or attributes.get("id", "").split()[:1]
    return ".".join([tag, *sorted({_DIGITS.sub("#", n.lower()) for n in names})])


def joined(path: str, part: str) -> str:
    """A path one level deeper; the upper levels of a very long one become their digest."""
    return f"{path}/{part}" if len(path) + len(part) < 400 else f"{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}/{part[:200]}"


def furniture(tag: str, attributes: dict[str, str]) -> int:
    """2 if an element can't be part of an article, 1 if its class or id says so, else 0."""
    role = attributes.get("role", "").lower()
    if tag in DROPPED or role in ROLES or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 1 if tag in ("form", "fieldset", "label") else 2
    found = 0
    for name in _names(attributes) if tag not in ("html", "body") else ():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in WITHOUT:
            continue
        if READERS.intersection(words):
            return 2
        hit = FURNITURE.intersection(words)
        if hit and not (hit <= MILD and OWN.intersection(words) - {"page", "body", "main"}):
            found = 1
    return 0 if found and tag in ("article", "main") else found


class Page:
    """A page's containers and blocks of text in its order, read in one pass; ``containers[0]`` is the document (path ``#``)."""

    def __init__(self, html: str):
        self.containers = [Container("#", -1, False)]
        self.blocks: list[Block] = []
        self._stack = [Element("", "", 0, 0, 0, False)]
        self._open: Counter = Counter()
        self._text: list[str] = []
        self._links = self._anchor = 0
        self._read(html)
        self._end_block()

    def _read(self, html: str) -> None:
        at, step = 0, _TOKEN.search
        while m := step(html, at):
            if m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            if name in RAW:
                close = _CLOSE[name].search(html, at)
                at = close.end() if close else len(html)
            elif name == "br":
                self._say(" ")
            elif name in BLOCKS or name not in VOID:
                self._begin(name, m[3])
        self._say(html[at:])

    def _say(self, text: str) -> None:
        if self._stack[-1].junk == 0 and text:
            text = unescape(text)
            self._text.append(text)
            if self._anchor:
                self._links += len(text)

    def _end_block(self) -> None:
        if not self._text:
            return
        text, links = " ".join("".join(self._text).split()), self._links
        self._text, self._links = [], 0
        if text:
            e = self._stack[-1]
            self.blocks.append(Block(text, e.container, e.tag, min(links, len(text))))

    def _begin(self, tag: str, rest: str) -> None:
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest and not rest.isspace() else {}
        if tag not in BLOCKS:
            top = self._stack[-1]
            if top.junk == 0 and (junk := furniture(tag, attributes)):
                self._stack.append(Element(tag, top.path, top.parent, top.container, junk, top.article))
                self._open[tag] += 1
            else:
                top.inline[tag] += 1
                self._anchor += tag == "a"
            return
        self._end_block()
        if rule := IMPLIED.get(tag):
            ended, until = rule
            for n in range(len(self._stack) - 1, max(0, len(self._stack) - NEAR), -1):
                e = self._stack[n].tag
                if e in until or (e in CONTAINERS and tag not in ("tr", "thead", "tbody", "tfoot", "td", "th", "body")):
                    break
                if e in ended:
                    self._pop(n)
                    if e == tag or tag not in ("li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot"):
                        break
        if tag in VOID:
            return
        top = self._stack[-1]
        junk, article = max(top.junk, furniture(tag, attributes)), top.article or tag in ("article", "main")
        if junk == 1 and (tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")):
            junk = 0
        if tag == "header":
            junk = max(junk, 0 if top.article else 2)
        elif junk == 0 and any(e.tag == "header" for e in self._stack[-4:]) and tag not in HEADINGS and tag not in CONTAINERS and tag != "hgroup":
            junk = 1  # by-lines in an article's header
        path = joined(top.path, label(tag, attributes))
        container = top.container
        if tag in CONTAINERS and junk == 0:
            own = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
            own = own or (tag != "body" and bool(TITLED.intersection(w.lower() for n in _names(attributes) for w in _WORDS.findall(n))))
            self.containers.append(Container(path, top.container, own))
            container = len(self.containers) - 1
        self._stack.append(Element(tag, path, top.container, container, junk, article))
        self._open[tag] += 1

    def _pop(self, n: int) -> None:
        for e in self._stack[n:]:
            self._open[e.tag] -= 1
            self._anchor -= e.inline["a"]
        del self._stack[n:]

    def _end(self, tag: str) -> None:
        top = self._stack[-1]
        if tag not in BLOCKS:
            if top.inline[tag]:
                top.inline[tag] -= 1
                self._anchor -= tag == "a"
            elif self._open[tag]:  # an inline element that is kept, as it hides what is inside, and what was left open in it
                for n in range(len(self._stack) - 1, max(0, len(self._stack) - NEAR), -1):
                    if self._stack[n].tag == tag:
                        self._pop(n)
                        break
                    if self._stack[n].tag in CONTAINERS:
                        break
            return
        self._end_block()
        if self._open[tag]:
            n = len(self._stack) - 1
            while self._stack[n].tag != tag:
                n -= 1
            self._pop(n)

    def scored(self) -> dict[str, Container]:
        """Containers by path, those of one path together: characters, bare ones and those of links, all with what is
        inside, and those that stand directly in them; and a score: running text counts whole where it stands, half a level above, a quarter above that; links
        count against it."""
        for b in self.blocks:
            n, running = len(b.text), b.kind in TEXTUAL
            c = self.containers[b.container]
            c.chars += n
            c.direct += n
            c.links += b.links
            c.bare += 0 if running else n
            value = (n - 2.0 * b.links) * (0.2 if b.kind in HEADINGS else 1.0 if running else 0.5)
            at, share = b.container, 1.0
            for _ in range(3):
                if at < 0:
                    break
                self.containers[at].score += value * share
                at, share = self.containers[at].parent, share / 2
        out: dict[str, Container] = {}
        for c in reversed(self.containers):
            if c.parent >= 0:
                p = self.containers[c.parent]
                p.chars += c.chars
                p.bare += c.bare
                p.links += c.links
            if c.path in out:
                o = out[c.path]
                o.chars, o.direct, o.bare, o.links, o.score, o.own = o.chars + c.chars, o.direct + c.direct, o.bare + c.bare, o.links + c.links, o.score + c.score, o.own or c.own
            else:
                out[c.path] = Container(c.path, c.parent, c.own, c.chars, c.direct, c.bare, c.links, c.score)
        return out

    def best(self) -> tuple[str, float] | None:
        """The path that the page votes for and its score: the best container, or one around it that is an article by its
        name or adds nothing but running text of its own."""
        by = self.scored()
        good = [c for c in by.values() if c.chars]
        if not good:
            return None
        now = max(good, key=lambda c: (c.score * (1.5 if c.own else 1.0), c.own, -len(c.path)))
        first = top = now
        chain = True
        while now.parent > 0:
            around = by[self.containers[now.parent].path]
            more, links = around.chars - first.chars, around.links - first.links
            quiet = more > 0 and links * 3 < more
            if around.path == "/html":
                break
            if quiet and (around.own or (chain and around.bare == first.bare and around.chars - now.chars == around.direct)):
                top = around
            elif around.chars > now.chars:
                chain = False
            now = around
        return top.path, first.score

    def text(self, path: str) -> str:
        """The blocks inside the containers of a path, in the page's order."""
        inside = [False] * len(self.containers)
        for i, c in enumerate(self.containers):
            inside[i] = c.path == path or (c.parent >= 0 and inside[c.parent])
        return "\n\n".join(b.text for b in self.blocks if inside[b.container])


def host_of(url: Column) -> Column:
    """The host of a URL, A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, path, votes, score): how many pages of a host have their best container at a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = b.column("host").to_pylist()
            for begin, end, texts in text_chunks(b.column("html")):
                found: dict[tuple[str, str], list[float]] = {}
                for host, html in zip(hosts[begin:end], texts, strict=True):
                    if html and (best := Page(html).best()):
                        row = found.setdefault((host, best[0]), [0, 0.0])
                        row[0], row[1] = row[0] + 1, row[1] + best[1]
                if found:
                    rows = [(*k, *v) for k, v in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["host", "path", "votes", "score"])

    rows = pages.mapInArrow(run, "host string, path string, votes long, score double")
    return rows.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def winners(counted: DataFrame, most: int = PATHS) -> DataFrame:
    """(host, paths): each host's paths with most votes, the first one first, ties by score, then path."""
    order = F.struct((-F.col("votes")).alias("v"), (-F.round("score")).alias("s"), "path")
    salted = counted.select("host", order.alias("o"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"))
    best = lambda by, x: F.slice(F.array_sort(x), 1, most)  # noqa: E731, ARG005
    parts = salted.groupBy("host", "salt").agg(best("salt", F.collect_list("o")).alias("o"))
    whole = parts.groupBy("host").agg(best("host", F.flatten(F.collect_list("o"))).alias("o"))
    return whole.select("host", F.transform("o", lambda x: x["path"]).alias("paths"))


def main_texts(pages: DataFrame, most: int = PATHS) -> DataFrame:
    """Each page's article: page_id, url, text, n_chars.

    Every page is read into blocks of text and containers, without menus, headers, footers, asides, forms, scripts, comments
    and what classes or ids call so. It votes for the path (tags and classes, numbers as wildcards) of its best container; a
    page is then read again at the path with most votes in its host among those that it has, or else at its own best one.
    Character references are decoded, white space inside a block becomes one space, blocks are joined by two line feeds.

    Null html or a page without text: an empty text. Null urls share the empty host. Repeated rows are pages of their own; other
    columns are ignored; an empty table gives no row. Votes are summed map-side, so a host with a third of all pages sends a
    row for each of its paths and task; its pages are joined in ``SALTS`` parts where the winners are too many to broadcast.
    """
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), host_of(url).alias("host"))
    won = cut(winners(votes(rows), most), "winners")
    won = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("paths").to_pylist()
            for begin, end, texts in text_chunks(b.column("html")):
                out = []
                for html, paths in zip(texts, lists[begin:end], strict=True):
                    text = ""
                    if html:
                        page = Page(html)
                        held = {c.path for c in page.containers}
                        path = next((p for p in paths or () if p in held and page.text(p)), None) or (page.best() or [None])[0]
                        text = page.text(path) if path else ""
                    out.append(text)
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(begin, end - begin), b.column("url").slice(begin, end - begin), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return salted.join(won, ["host", "salt"], "left").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
