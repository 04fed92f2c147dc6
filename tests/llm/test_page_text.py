import re
from html import unescape

import pytest

from trackgraph.llm import markup, page_text

SCHEMA = "page_id long, url string, html string, text string, host string"


def lines(html):
    page = markup.read(html)
    markup.hashed(page)
    return markup.blocks(page, markup.layout(page))


@pytest.mark.parametrize(("html", "want"), [
    ("", []), ("plain &lt;b&gt; text", ["plain <b> text"]), ("a<br>b<hr>c", ["a b", "c"]), ("<p>a\n \t b&nbsp;c</p>", ["a b c"]),
    ("<p><b>one.<br><p>two</p><p>three", ["one.", "two", "three"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<p>a < b &amp c &am &#8212; &#x41;</p>", ["a < b & c &am — A"]), ("<P CLASS='x>y'>quoted</P>", ["quoted"]), ("x</div>y", ["xy"]), ("<p>cut <a hre", ["cut"]),
    ("<script>var a = '</p><p>no';</script>yes<style>no</style><!-- <p>no</p> --><!-- > no", ["yes"]), ("<textarea><p>no</textarea>yes", ["yes"]), ("a<script>no", ["a"]),
    ("<title>no</title><body>yes", ["yes"]), ("<head><title>no</title><p>yes", ["yes"]), ("<head><meta x>text", ["text"]),
    ("<nav>no</nav><header>no</header><p>yes</p><footer>no</footer><aside>no</aside><form><input>no</form>", ["yes"]),
    ("<form><h1>Title</h1><p>page in a form</p><form class=search>no</form></form>", ["Title", "page in a form"]),
    ("<div class='cookie-notice'>no</div><div id=sidebarLeft>no</div><div class='top-ad'>no</div><div class='has-sidebar adder'>yes</div>", ["yes"]),
    ("<div role=navigation>no</div><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p>yes", ["yes"]),
    ("<div>out</div><article><header><h1>T</h1></header><p>in</p><div class=share>no</div></article><section id=comments><article>no</article></section>", ["T", "in"]),
    ("<main><h1>T</h1><p>in</p></main><p>out</p>", ["T", "in"]), ("<div class='page no-ads'><div itemprop=articleBody>in</div>out</div>", ["in"]),
    ("<div class='site-sidebar'><article>teaser</article></div><p>body</p>", ["body"]), ("<pre>a\n  b</pre><blockquote>q<p>r</blockquote>", ["a b", "q", "r"]),
])
def test_blocks(html, want):
    assert lines(html) == want


def test_deep_and_long_pages():
    assert lines("<div>" * 30_000 + "deep" + "</section>" * 30_000) == ["deep"]
    assert lines("<p>" + "word " * 300_000) == [("word " * 300_000).strip()]
    assert lines("<" * 50_000 + "a" + "=" * 50_000 + "'" * 9)[:1] != []


def texts(spark, rows):
    table = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA).repartition(3)
    got = page_text.with_main_text(table)
    assert got.columns == ["page_id", "url", "html", "host", "text"]
    return {(r.page_id, r.url): r.text for r in got.collect()}


def test_templates_of_a_site_go(spark):
    notice = "<div class=k1><div>We use biscuits.</div><span>Fine</span></div>"
    share = "<div class=k2>Tell a friend</div>"
    rows = [(k, "https://User@Site.example:80/p", f"{notice}<h1>Title {k}</h1><p>Own text {k} of the page</p><div>Imprint</div>") for k in range(8)]
    rows += [(100 + k, "https://art.example/p", f"{notice}<article><p>All rights kept.</p><p>Own text {k} of the page</p>{share}</article>") for k in range(8)]
    rows += [(200 + k, "https://few.example/", f"{notice}<p>Other text {k}</p>") for k in range(4)]  # too few pages
    rows += [(300 + k, "https://copies.example/", "<p>The same long article on many pages</p><p>Second</p>") for k in range(30)]  # copies are one page
    rows += [(400 + k, None, f"{notice}<p>Text {k}</p>") for k in range(8)] + [(500 + k, "no host", f"{notice}<p>Text {k}</p>") for k in range(8)]
    got = texts(spark, rows)
    for (i, _), text in got.items():
        own = i % 100
        want = {0: f"Title {own}\nOwn text {own} of the page", 1: f"All rights kept.\nOwn text {own} of the page", 2: f"We use biscuits.\nFine\nOther text {own}",
                3: "The same long article on many pages\nSecond"}.get(i // 100, f"We use biscuits.\nFine\nText {own}")
        assert text == want


def test_large_groups_meet_templates_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(page_text, "BROADCAST_DIGESTS", 0)
    rows = [(k, f"https://s{k % 3}.example/", f"<div>Imprint</div><p>Own text {k}</p>") for k in range(30)] + [(99, None, "<p>x</p>")]
    assert texts(spark, rows) == {(k, u): ("x" if k == 99 else f"Own text {k}") for k, u, _ in rows}


def test_odd_pages(spark):
    rows = [(1, "https://a.example/", None), (2, "https://a.example/", ""), (None, None, None), (3, "https://a.example/", "<p>x"), (3, "https://a.example/", "<p>x")]
    assert texts(spark, rows) == {(1, "https://a.example/"): "", (2, "https://a.example/"): "", (None, None): "", (3, "https://a.example/"): "x"}
    assert page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 5
    assert page_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """The given pages have one article of headings and paragraphs, all of whose text counts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in page_text.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*(>|$)", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
