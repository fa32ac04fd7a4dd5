import html
import re

from lamella.llm import html_extract as he
from lamella.llm.common import table


def test_whole_pages(spark, sf):
    """The pages are regular enough to cut the article out by a pattern."""
    rows = he.op5_html_extraction(spark, sf).collect()
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)
        want = " ".join(html.unescape(re.sub(r"<(/?[a-z][^<>]*)(>|\Z)", lambda m: "" if m[1].strip("/") == "b" else " ", inner[1])).split()) if inner else ""
        assert r.text == want and r.n_chars == len(want)


NOISY = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site"><h1>Site</h1><p>Long site claim, with commas, many of them, indeed so many.</p></header>
<nav><a href="/a">A</a></nav><div id="cookie-notice"><p>We use cookies, and more, and more, and more.</p></div>
<div class="wrap"><div class="post"><h1>Title &amp; more</h1><p>First <b>para</b>graph, with
  text<br>and a break.<p>Second one &lt;x&gt;, unclosed<ul><li>item one<li>item <a href="#">two</a></ul>
<form><input value="x"><label>Name, please, now</label></form><script>var a = "<p>no</p>";</script>
<div class="ad-slot">Buy, buy, buy, buy, buy</div><blockquote>Quoted, too.</blockquote>
<section class="comments"><p>Reader, one, two, three, four, five, six.</p></section></div>
<aside><p>Aside, aside, aside, aside, aside</p></aside></div><footer>&copy; me, you, them</footer></body></html>"""


def test_noise():
    assert he.main_text(NOISY) == (
        "Title & more First paragraph, with text and a break. Second one <x>, unclosed item one item two Quoted, too."
    )


def test_odd_pages():
    assert he.main_text(None) == he.main_text("") == he.main_text("<nav><a>x</a></nav>") == he.main_text("<script>x") == ""
    assert he.main_text("plain words &am") == "plain words &am"
    assert he.main_text("<article><p>cut off in a tag <b cla") == "cut off in a tag"
    assert he.main_text("<article>" + "<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    assert he.main_text('<p title="a > b">one</p><p>two') == "one two"
    assert he.main_text("a < b and <3 <p>x</p>").startswith("a < b")
    assert he.main_text("<!-- never closed <p>x</p>") == ""
    assert len(he.main_text("<article><p>" + "word, " * 200000 + "</article>")) == 200000 * 6 - 1
    two = "<main><section><p>One, two.</p></section><section><p>Three.</p></section></main><div class='related'><p>no, no, no</p></div>"
    assert he.main_text(two) == "One, two. Three."


def test_edges(spark):
    rows = [(1, "u", None), (2, None, "<p>x</p>"), (2, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "5 AS text")
    got = sorted((r.page_id, r.text, r.n_chars) for r in he.extract(pages).collect())
    assert got == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert he.extract(pages.limit(0)).count() == 0


def test_names_do_not_take_article_text():
    page = (
        "<body><div class='menu'>No</div><article><h1>T</h1><p class='related-work'>Related, one.</p><div class='social-history'><p>Social, two.</p></div>"
        "<p id='copyright-law'>Law, three.</p><label>Label four</label> <math><mi>x</mi><mo>=</mo><mn>5</mn></math><section id='discussion'><p>Six, six.</p></section>"
        "<ul><li><a href='/r1'>Reference seven</a></li><li><a href='/r2'>Reference eight</a></li></ul>"
        "<div class='share-buttons'>No</div><section class='comments'><p>No, no</p></section><div id='ad-slot-3'>No</div><form><label>No</label></form></article></body>"
    )
    assert he.main_text(page) == "T Related, one. Social, two. Law, three. Label four x=5 Six, six. Reference seven Reference eight"
    plain = "<div><div class='social-history'><p>One, two, three.</p><p>Four, five.</p></div><div class='site-footer'><p>No, no, no</p></div><p class='copyright'>No</p></div>"
    assert he.main_text(plain) == "One, two, three. Four, five."


def test_time_is_linear():
    """Deep nesting, open paragraphs and stray end tags: a megabyte in a few seconds, and twice the page in about twice the time."""
    import time

    for unit in ("<div>x ", "<ul><li>a, b", "<span>y</b> ", "<p>z, <i>", "</div><b>w</p>", "<table><tr><td>v"):
        took = []
        for size in (250_000, 1_000_000):
            page = "<b><article>" + unit * (size // len(unit))
            began = time.process_time()
            he.main_text(page)
            took.append(time.process_time() - began)
        assert took[1] < 8 and took[1] < 10 * took[0] + 0.2, (unit, took)
