"""Main texts of pages of several templates, votes of hosts, and hostile markup."""

import html
import random
import re
import time

import pytest

from litlake.llm import main_text as mt

SCHEMA = "page_id long, url string, html string, text string, host string"
P = ["First paragraph, which says a good deal about what happened, when and why it did.", "A second one follows; it is as long as the first, and as plain in what it says.", "The third is short."]


def read(page):
    p = mt.Page(page)
    best = p.best()
    return p.text(best[0]) if best else ""


def body(*parts):
    return "<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body>" + "".join(parts) + "</body></html>"


ARTICLE = "<h1>Title &amp; more</h1>" + "".join(f"<p>{p}</p>" for p in P)
WANT = "\n\n".join(["Title & more", *P])
FURNITURE = [
    "<nav><ul><li><a href=/a>Home page of this site</a></li></ul></nav>", "<header><h1>The Site</h1><p>Its slogan is here, for all to read.</p></header>", "<div class='main-menu'><a href=x>One</a> <a href=y>Two</a></div>",
    '<div id="sidebar-left"><p>Read also what we wrote about other things a long time ago.</p></div>', "<aside><p>Not this text, which is beside the matter.</p></aside>", '<div class="ad">Buy this now, it is cheap and good!</div>',
    "<footer>&copy; somebody &middot; imprint</footer>", "<form action=x>Search <input name=q> <button>Go</button></form>", '<div class="cookie-notice"><p>We use cookies, as all do. Do you agree with that?</p></div>',
    "<section class='comments'><h3>Comments</h3><article class='comment'><p>I like this article a lot, it is the best of all. " + "Really. " * 80 + "</p></article></section>", "<!-- <p>hidden</p> --><noscript>Turn it on</noscript><iframe src=x>none</iframe>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', '<div id="content"><div class="entry">{}</div></div>', '<main><article class="post-17">{}</article></main>', '<div class="with-sidebar"><article>{}</article></div>'])
def test_furniture_goes(wrap):
    rng = random.Random(3)
    for _ in range(10):
        around = rng.sample(FURNITURE, 6)
        inside = rng.sample([f for f in FURNITURE if "slogan" not in f], 3)
        page = body(*around[:3], wrap.format(ARTICLE + "".join(inside)), *around[3:])
        assert read(page) == WANT, page


def test_blocks_and_references():
    assert read(body("<article><h1>A</h1><p><b>B<br>b<p>C\n \t c&nbsp;d</b> &lt;e&gt;<!-- x -->f<i>g</i><ul><li>one<li>two</ul><div>bare</div>&#65;&eacute;&am</article>")) == "A\n\nB b\n\nC c d <e>fg\n\none\n\ntwo\n\nbare\n\nAé&am"
    assert read(body("<article><table><tr><td>a<td>b<tr><td>c</table><blockquote><p>q</p></blockquote><pre>x\n  y</pre><dl><dt>t<dd>d</dl></article>")) == "a\n\nb\n\nc\n\nq\n\nx y\n\nt\n\nd"
    assert read(body('<article><header><h1>Title</h1><p class="by">by me</p></header><p>Some text that is the article.</p><footer>tags</footer></article>')) == "Title\n\nSome text that is the article."
    assert read("plain text <b>only</b>") == "plain text only" and read("<p>a fragment<p>of two") == "a fragment\n\nof two"


def test_hidden_inline_elements_end_where_they_should():
    assert read(body("<article><p>one <span class=ad>buy <span>now</span> here</span> two <button>go</button>three</p><noscript><p>turn on</noscript><p>four <a class=share href=x>share</a> five</p></article>")) == "one two three\n\nfour five"
    assert read(body('<div class="elementor-widget-text"><p>The text of a page that was put together from boxes.</p></div>')) == "The text of a page that was put together from boxes."
    assert read(body(f'<div class="nav-wrapper"><div role="main"><p>{P[0]}</p></div><p>not this</p></div>')) == P[0]


def test_labels_are_general():
    assert mt.label("div", {"class": "post-123  b a"}) == mt.label("div", {"class": "b a post-9"}) == "div.a.b.post-#"
    assert mt.label("div", {"id": "x7"}) == "div.x#"
    assert len(mt.joined("a" * 399, "div.b")) < 60


def test_hosts_vote(spark):
    """A page whose own best container is an unnamed box is read at the path that its host's other pages have."""
    rows, junk = [], "<div><p>" + "Some long text in a box that no name gives away, on this page only. " * 9 + "</p></div>"
    for i in range(12):
        art = f'<div class="c{i}"><div class="x"><p>{P[0]} {i}</p><p>{P[1]}</p></div></div>'
        rows.append((i, f"http://A.example.com/{i}", body(art, junk if i == 5 else ""), None, "clash"))
    rows += [(20 + i, "http://b.example.com/?x", body(FURNITURE[0], f"<article>{ARTICLE}</article>", FURNITURE[9]), None, "") for i in range(3)] + [(20, "http://b.example.com/?x", body(f"<article>{ARTICLE}</article>"), None, "")]
    rows += [(40, None, body("<p>no host</p>"), None, ""), (41, "x", None, None, ""), (42, "http://b.example.com", "", None, ""), (43, "http://b.example.com/z", body("<section class=odd><p>another template</p></section>"), None, ""), (44, "http://c.example.com", body(FURNITURE[0]), None, "")]
    out = mt.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {}
    for r in out:
        got.setdefault(r["page_id"], []).append(r["text"])
    assert [got[i] for i in range(12)] == [[f"{P[0]} {i}\n\n{P[1]}"] for i in range(12)]
    assert got[20] == [WANT, WANT] and got[21] == [WANT] and got[40] == ["no host"] and got[41] == [""] and got[42] == [""] and got[43] == ["another template"] and got[44] == [""]
    assert mt.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_the_articles_of_the_tables():
    duckdb = pytest.importorskip("duckdb")
    try:
        rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    except duckdb.IOException:
        pytest.skip("needs the tables")
    for (page,) in rows:
        inner = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert read(page) == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p>", "<", "<!--", '<a href="', "<li>", "<i><div>", "<td>", "<span class=ad>", '<a "<a" ', "<a class='", "</b>", "<table><tr>", "&#x"])
def test_time_is_linear(part):
    def took(n):
        began = time.perf_counter()
        read(part * n + "x" + "</i></p>" * n)
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 12 * max(took(8_000), 0.02)
