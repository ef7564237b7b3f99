import html
import re

import pytest
from foldlog.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="home page">
<header><a href="/">Site</a><p>A slogan, with commas, and more, of them, here.</p></header>
<nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everyone does, and you may, or may not, agree.</p></div>
<div id="wrap"><div class="%s">
<h1>Title &amp; more</h1><p>First   para,
with <b>bold</b>, a <a href=x>link</a> and entities: &lt;b&gt; &eacute;&#233;.
<p>Second<br>line<script>if (a < b) { "</p>" }</script> goes on.</p>
<ul><li>one<li>two</ul><table><tr><td>a</td><td>b</tr></table>
<div class="ad"><p>Buy this, now, or else, you miss it!</p></div>
<form action=x><label>Name</label><input name=n></form>
<!-- hidden <p>comment</p> --><blockquote>Quoted, at length, by someone.</blockquote></div>
<div class="sidebar"><p>Side text, with commas, of all kinds, to mislead, the scorer.</p></div></div>
<section id="comments"><h2>3 comments</h2><article class="comment"><p>Nice, very nice, really, I agree, with all of it.</p></article></section>
<div role="complementary">Aside text.</div><footer>&copy; Us, and others.</footer></body></html>"""
TEXT = "Title & more\nFirst para, with bold, a link and entities: <b> éé.\nSecond line goes on.\none\ntwo\na b\nQuoted, at length, by someone."


@pytest.mark.parametrize("name", ["content", "x", "post-body", "entry"])
def test_article_without_its_surroundings(name):
    assert extraction.main_text(PAGE % name) == TEXT


def test_article_element_and_its_header():
    page = (PAGE % "x").replace('<div class="x">', "<article><header>").replace("<p>First", "</header><p>First").replace("someone.</blockquote></div>", "someone.</blockquote></article>")
    assert extraction.main_text(page) == TEXT


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("  \n", ""), ("just text &amp; more", "just text & more"), ("<!-- open", ""), ("<p>a<p>b <i>c", "a\nb c"),
                                            ("<article><p>short</article>", "short"), ("<p title='x > y'>q</p>", "q"), ("a < b and <3 c", "a < b and <3 c"), ("<script>x", ""), ("<div>" * 3000 + "deep", "deep")])
def test_odd_pages(page, text):
    assert extraction.main_text(page) == text


def test_long_page_whole():
    words = " ".join(f"w{i}" for i in range(60000))
    page = f"<nav>x</nav><article>{''.join(f'<p>{words}, {i}.</p>' for i in range(5))}</article>"
    assert extraction.main_text(page) == "\n".join(f"{words}, {i}." for i in range(5))


def test_query_on_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extraction.extract(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        cut = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
        expected = "\n".join(x for x in (" ".join(html.unescape(c).split()) for c in cut) if x)
        assert got[row["page_id"]]["text"] == expected and got[row["page_id"]]["n_chars"] == len(expected)


def test_nulls_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x", "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    rows = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in extraction.extract(df, ["page_id", "url", "text"]).collect())
    assert rows == [("1", "None", "", 0), ("None", "u", "x", 1), ("None", "u", "x", 1)]
    assert extraction.extract(df.limit(0)).count() == 0
