from __future__ import annotations

import html
import re

import numpy as np

from habitus.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href='/b>c'>News</a></ul></nav>
<div class="ad-box"><p>Buy ten now, a long advert that looks much like a paragraph of text does.</p></div>
<div id="cookie-notice">We use cookies.</div>
<ARTICLE><header class="entry-header"><h1>A  title &amp; more</h1></header><p>First&nbsp;paragraph <b>bold</b>er, 1 &lt; 2.
<p>Second <a href="x">link</a> text.<br>After<!-- hidden > --> the break, 3 < 4.<p>Short.</p>
<aside>Pull quote</aside><form><input name="q"><button>Go</button></form><ul><li>One</li><li>Two</li></ul>
<section class="comments"><p>First! A comment of a reader, as long as a paragraph of the article may be.</p></section>
<div role="alert">Careful</div><p hidden>Unseen</p><figure><img alt="x"><figcaption>Caption</figcaption></figure></article>
<footer>&copy; site &middot; all rights</footer></body></html>"""
TEXT = "A title & more First paragraph bolder, 1 < 2. Second link text. After the break, 3 < 4. Short. One Two Caption"


def test_page():
    assert htmltext.page_text(PAGE, htmltext.train()) == TEXT


def test_page_without_content_markup():
    text = " ".join(["word"] * 40)
    page = f"<div class=menu><a href=/>Home</a><a href=/x>Other</a></div><div><h2>Six words make up this heading</h2><p>{text} one</p><p>{text} two</p></div><div class='footer'>imprint</div>"
    assert htmltext.page_text(page, htmltext.train()) == f"Six words make up this heading {text} one {text} two"


def test_text_beside_an_article():
    text = " ".join(["word"] * 40)
    page = f"<div><p>{text} before</p></div><main><p>{text}</p><p>Short.</p></main><div><p>{text} after</p></div>"
    assert htmltext.page_text(page, htmltext.train()) == f"{text} Short."


def test_names_of_wrappers_are_no_verdict():
    tree = htmltext.train()
    one, two = "alpha " + "word " * 58 + "end", "beta " + "word " * 58 + "end"
    text = f"<p>{one}</p><p>{two}</p>"
    for page in (
        f'<body class="single no-sidebar">{text}</body>', f'<article class="post comments-open">{text}</article>',
        f'<section id="related-work">{text}</section>', f'<main class="has-nav">{text}</main>',
        f'<div class="alerts-guide">{text}</div>', f'<div class="elementor-widget">{text}</div>',
        f"<form action=x><div>{text}</div></form>", f'<form id="form1"><article>{text}</article><input></form>',
        f'<div class="related"><div class=search>Find</div>{text}<div class="share-box">Tell all your friends</div></div>',
    ):
        assert htmltext.page_text(page, tree) == f"{one} {two}", page
    page = f'<article><h1>T</h1><section id="related-work"><h2 id="search-methods">Search methods</h2>{text}</section><section id="share">{text}</section></article>'
    assert htmltext.page_text(page, tree).startswith(f"T Search methods {one} {two}")


def test_comments_longer_than_the_article():
    article, comment = "<p>" + "word " * 40 + "</p>", "<li>" + "other " * 60 + "</li>"
    for name in ('id="comments"', 'class="comment-list"', 'class="user-comments x"'):
        page = f"<article>{article}<ol {name}>{comment * 5}</ol></article>"
        assert htmltext.page_text(page, htmltext.train()) == ("word " * 40).strip()
        page = f"<div>{article}</div><section {name}>{comment * 5}</section>"
        assert htmltext.page_text(page, htmltext.train()) == ("word " * 40).strip()


def test_ends_of_pages_without_markup():
    tree = htmltext.train()
    long = " ".join(["word"] * 48)
    for n in (12, 20, 28, 34):
        last = " ".join(["last"] * n)
        for tail in ("", "<p>&copy; 2020 Example. All rights reserved.</p>"):
            page = f"<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><h1>A heading of five words</h1><p>{long}</p><p>{long}</p><p>{last}</p>{tail}"
            assert htmltext.page_text(page, tree) == f"A heading of five words {long} {long} {last}"
    page = f"<p>We use cookies to make this site work better for you and others.</p><ul><li><a href=/>Home</a></li></ul><p>{long}</p><p>{long}</p>"
    assert htmltext.page_text(page, tree) == f"{long} {long}"


def test_odd_pages():
    tree = htmltext.train()
    for page in (None, "", "   ", "<", "<p", "<!--", "<article>", "</article></p>", "<script>x", "<nav>a</nav>", "<article><p>  </p>"):
        assert htmltext.page_text(page, tree) == ""
    assert htmltext.page_text("<article><p>cut off <a href='x", tree) == "cut off"
    assert htmltext.page_text("<article><p>a</p></div></article><p>b", tree) == "a"
    assert htmltext.page_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, tree) == "deep"
    assert htmltext.page_text("<article><p>" + "x &amp; " * 50_000 + "</article>", tree) == "x & " * 49_999 + "x &"


def test_tree_fits_its_table_and_uses_the_neighbours():
    table = np.array(htmltext.LABELLED, float)
    tree = htmltext.train()
    assert (tree.of(table[:, :-1]) == (table[:, -1] > 0)).all()
    used = set()

    def walk(node):
        if node.split:
            used.add(htmltext.FEATURES[node.split[0]])
            walk(node.low)
            walk(node.high)

    walk(tree)
    assert used & {"words_before", "density_before"} and used & {"words_after", "density_after"}
    assert "named_share" in used


def test_sample_pages(spark, sample):
    """The sample's pages keep their articles in one element of paragraphs."""
    pages = spark.read.parquet(f"{sample}/pages.parquet")
    found = {r.page_id: r for r in htmltext.extract(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub("</?b>", "", article))
        want = " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (want, len(want), r.url)


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article>é😀</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "0 as n_chars")
    got = sorted(htmltext.extract(pages).collect(), key=str)
    assert len(got) == 5 and sum(r.text == TEXT for r in got) == 2 and {r.n_chars for r in got} == {len(TEXT), 0, 2}
    assert htmltext.extract(pages.where("false")).count() == 0
