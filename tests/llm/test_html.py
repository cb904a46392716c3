"""Main text of pages: exact expected texts over many layouts, and the template classes."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from logrung.llm.html_template import extract_main_text, main_text, outside_of_dense, templates, token_table
from logrung.llm.queries import op4_html_template

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><article>x';</script></head><body>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain text", "plain text"),
        (HEAD + "<nav>n</nav><article><h1>Hi</h1><p>One <b>bold</b>er.</p><p>Two</p></article><footer>f</footer>", "Hi One bolder. Two"),
        (HEAD + "<article><p><b>Open.<br><p>Next &amp; &lt;x&gt; &eacute;&#233;&#xE9;&nbsp;end</article><aside>no</aside>", "Open. Next & <x> ééé end"),
        (HEAD + '<div class="sidebar">s</div><main><p>a</p><form>f</form><div id="comments"><article>c</article></div></main>', "a"),
        (HEAD + '<article><p>a\n\n  b\tc</p><div class="ad">buy</div><ul><li>x<li>y</ul><!-- no --><script>no</script></article>', "a b c x y"),
        (HEAD + '<div class="cookie-notice">no</div><article>t<span hidden>h</span><div style="display: none">d</div></article>', "t"),
        (HEAD + "<header>site</header><article><header><h1>Title</h1></header>text<footer>by</footer></article>", "Title text"),
        (HEAD + "<article>a < b and 3<4 <> c</article>", "a < b and 3<4 <> c"),
        (HEAD + '<article title="a > b">q<img alt="x > y">r<br/>s</article>', "qr s"),
        (HEAD + "<article>unclosed <b>all <i>the way", "unclosed all the way"),
        ("<article></article><p>outside only</p>", "outside only"),
        (HEAD + "<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        (HEAD + "<article><noscript>no</noscript><textarea>no</textarea>yes</article>", "yes"),
        ("<article>" + "<p>word</p>" * 20_000 + "</article>", " ".join(["word"] * 20_000)),
        ("<article><p>a</p></div></section></article></p>tail", "a"),
        ("<article>" + '<a href="' * 200, None),
    ],
)
def test_main_text(page, want):
    got = main_text(page, [])
    assert want is None or got == want


def test_query_takes_each_article_whole(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_html_template(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"<[^>]*>", re.sub(r"</?b>", "", article))]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def _bare(i, extra=""):
    """A layout without a word of meaning in its tags."""
    return (
        f"<html><body><div class='x1'>Constant line</div><div class='x2'><a href='/{i}'>go {i}</a> <a>more {i}</a></div>"
        f"<div class='x3'><h2>Title {i}</h2><div>Body {i} of the page.</div></div>{extra}<div class='x4'>Made by us</div></body></html>"
    )


def test_template_of_a_host_tells_furniture_from_text(spark):
    rows = [(i, f"http://a.example/{i}", _bare(i)) for i in range(6)]
    rows += [(10, "http://a.example/odd", _bare(10, "<div class='y'>Only here</div>")), (11, "http://b.example/", _bare(11))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("furniture", F.lit(1))
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(3)).collect()}
    assert got[2] == "Title 2 Body 2 of the page."
    assert got[10] == "Title 10 Body 10 of the page. Only here"
    # One page alone shows nothing to be constant; its link block is still known.
    assert got[11] == "Constant line Title 11 Body 11 of the page. Made by us"


def test_classes_share_vectors_and_nest(spark):
    rows = [(i, "h", "<html><body><ul>" + "<li><i>x</i></li>" * (i + 1) + "</ul><p>t</p></body></html>") for i in range(5)]
    pages = spark.createDataFrame(rows, "row int, host string, html string").repartition(3)
    tokens = token_table(pages)
    found = {r.token: r for r in templates(tokens, pages.groupBy("host").agg(F.count("*").alias("host_pages"))).collect()}
    assert found["/html/body/ul/li"]["class"] == found["/html/body/ul/li/i"]["class"]
    assert found["/html"]["class"] == found["/html/body/p"]["class"] != found["/html/body/ul/li"]["class"]
    assert found["/html/body/ul/li"].parent_class == found["/html"]["class"] and found["/html"].parent_class is None
    assert {(r.token, r.pages, r.occurrences) for r in tokens.collect()} >= {("/html/body/ul/li", 5, 15), ("/html/body/p", 5, 5)}


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "no host", "<p>x</p>"), (2, "http://a.b/", "<article>y</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(r.text for r in extract_main_text(pages).collect())
    assert got == ["", "", "", "x", "y"]
    assert extract_main_text(pages.limit(0)).collect() == []


def test_links_in_sentences_and_copies_of_a_page_keep_their_text(spark):
    linked = "<div><p>Read <a href='/a'>the long manual</a> before <b>any</b> use of it.</p><ul><li><a>Home</a></li></ul></div>"
    copy = "<div><h2>Only title</h2><p>Only text.</p></div>"
    rows = [(1, "http://one.example/", linked)] + [(10 + i, "http://copies.example/", copy) for i in range(4)]
    rows += [(20 + i, "http://c.example/", f"<p>Sold by us</p><div>Price: <b>{i}</b> now</div>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(3)).collect()}
    assert got[1] == "Read the long manual before any use of it."
    assert all(got[10 + i] == "Only title Only text." for i in range(4))
    assert all(got[20 + i] == f"Price: {i} now" for i in range(4))


def test_the_template_decides_whether_an_article_element_is_the_article(spark):
    def page(i):
        teaser = f"<article>Teaser {i}</article>"
        return f"<body><div class='top'>Shop</div><h1>Title {i}</h1><section><p>{f'Long body {i} of it. ' * 9}</p></section>{teaser}</body>"

    rows = [(i, "http://a.example/", page(i)) for i in range(4)] + [
        (10 + i, "http://b.example/", f"<p>Offer {i}</p><article><h1>Title {i}</h1><p>{'Body. ' * 9}</p><p>Always.</p></article>") for i in range(4)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(3)).collect()}
    for i in range(4):
        assert got[i] == f"Title {i} {f'Long body {i} of it. ' * 9}Teaser {i}"
        assert got[10 + i] == f"Title {i} {'Body. ' * 9}Always."


def test_names_drop_nothing_of_an_article_that_the_template_does_not_confirm(spark):
    one = (
        '<body class="no-sidebar ad"><main class="with-sidebar"><article class="post comments-open comments">'
        '<p class="notice">Notice.</p><div class="related">Related work.</div><p class="legal">Law.</p>End</article></main></body>'
    )
    many = [f'<article><p class="notice">Notice {i}.</p><p>Body {i}.</p><div class="newsletter">Join us</div><p>Same.</p></article>' for i in range(4)]
    rows = [(9, "http://one.example/", one)] + [(i, "http://many.example/", x) for i, x in enumerate(many)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got[9] == "Notice. Related work. Law. End"
    assert [got[i] for i in range(4)] == [f"Notice {i}. Body {i}. Same." for i in range(4)]


ARTICLE = '<article><p title="hidden gem">Keep this.</p><p data-hidden="false" alt="class=ad id=footer">And this.</p></article>'


@pytest.mark.parametrize(
    "page",
    [
        HEAD + ARTICLE,
        HEAD + f'<form id="page"><nav>n</nav>{ARTICLE}<footer>f</footer></form>',
        HEAD + f'<div class="header"><div class="nav">Home</div>{ARTICLE}</div>',
        HEAD + f'<div class="main-nav">Home</div>{ARTICLE}',
        HEAD + f'<object data="x">{ARTICLE}',
        HEAD + f'<header>{ARTICLE}<form>search</form></header><div class="comments"><article>I say</article></div>',
        HEAD + f'<aside><article>teaser</article></aside>{ARTICLE}',
    ],
)
def test_wrappers_and_attributes_cost_no_text(spark, page):
    assert main_text(page, None) == "Keep this. And this."
    pages = spark.createDataFrame([(i, "http://a.example/", page) for i in range(4)], "page_id long, url string, html string")
    assert {r.text for r in extract_main_text(pages).collect()} == {"Keep this. And this."}


def test_a_form_around_a_page_without_an_article():
    assert main_text(HEAD + f"<form><p>{'Long text. ' * 9}</p><button>Go</button></form><p>End</p>", None) == f"{'Long text. ' * 9}End"
    assert main_text(HEAD + f"<p>{'Long text. ' * 9}</p><form>Name <input> please</form>", None) == ("Long text. " * 9).strip()


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<b>" * 200_000, "<b>" * 90_000 + "</i>" * 90_000, "<object>" * 120_000, "<!--" * 250_000, "<" * 1_000_000,
     '<a ">' * 150_001, "<p><b>" * 90_000, "<ul><li>" * 90_000, "<script>" * 120_000, '<p class="' + "x y " * 250_000 + '">t</p>'],
)
def test_a_megabyte_of_open_tags_takes_seconds(page):
    began = time.perf_counter()
    main_text(page, None)
    assert time.perf_counter() - began < 30


def test_an_advertisement_is_told_without_any_name(spark):
    rows = [(i, "http://a.example/", _bare(i, f"<div class='q'>Buy {i}</div>").replace("Body", "Body text " * 20)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(3)).collect()}
    assert got == {i: f"Title {i} {'Body text ' * 20} {i} of the page.".replace("  ", " ") for i in range(6)}


def test_what_lies_beside_the_densest_container():
    assert outside_of_dense([("/b/x/p", 900), ("/b/x/q", 10), ("/b/y", 50)]) == ["/b/y"]
    assert outside_of_dense([("/b/x/p", 900), ("/b/h1", 10), ("/b/y/z", 5)]) == ["/b/y/z"]
    assert outside_of_dense([("/b/x", 900), ("/b/y", 50)]) == []
    assert outside_of_dense([("/b/x/p", 500), ("/b/y/p", 400)]) == []
    assert outside_of_dense([]) == []
