import re
import time
from html import unescape

import pytest

from recollect.llm import html_extract as module
from recollect.llm._html import attributes, best_container, dropped, generalised, parse
from recollect.llm.html_extract import extract_main_text, host_paths, main_text

FILL = "This is a sentence of the article, long enough to read as text. "
DIRTY = """<!DOCTYPE html><html><head><title>Site | T</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>");</script></head>
<body class="has-sidebar"><header class="site"><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>Read this instead, it is a good text.</p></div>
<div class="layout with-sidebar"><article class="post post-17"><header><h1>Title &amp; more</h1><p>By someone</p></header>
<p>First <b>bold</b>ed <a href="x">link</a> para&shy;graph&nbsp;one.<p>Second
  one, &lt;b&gt; &#8217;quoted&#x27; &copy 2020.<ul><li>Point one<li>Point <i>two</i></ul>
<!-- <p>hidden</p> --><div class="ad-slot"><span>Buy now</span></div><form><label>Name</label><input name=q></form>
<aside>Other</aside><table><tr><td>Cell a<td>Cell b<tr><td>Cell c</table><blockquote>Quote.</blockquote><pre>a
   b</pre>x<br>y<noscript>Enable</noscript><p hidden>secret</p><p style="display: none">secret</p></article>
<section class="comments"><h2>2 comments</h2><article class="comment"><p>Great article, thank you for all of this text!</p></article></section></div>
<footer>&copy; Site</footer></body></html>"""


def test_boilerplate_goes():
    want = "Title & more First bolded link para\xadgraph one. Second one, <b> ’quoted' © 2020. Point one Point two Cell a Cell b Cell c Quote. a b x y"
    assert main_text(DIRTY, []) == want
    assert main_text(DIRTY, ["body>div.with>nothing", "body>div.layout.with-sidebar>article.post.post-#"]) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("  ", ""), ("<p></p>", ""), ("plain text", "plain text"), ("a<b c", "a"), ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
        ("<p>a<p>b</div></p>c", "a b c"), ("<p>a</p><!-- <p>b", "a"), ("<p>a</p><!--> b", "a b"), ("<p title='>'>a</p>", "a"), ('<p title="x>a</p><p>b</p>', "a b"),
        ("<article><p>a</article><p>b", "a"), ("<script>var a='</p>';", ""), ("<?php x ?>a<![CDATA[b]]>c</>d", "acd"), ("<P CLASS=ad>x</P><P>y</P>", "y"),
        ("<div class=ad><span>x</div>y", "y"), ("a <span class=ad>x <span>z</span> q</span>b", "a b"), ("<textarea><p>x</textarea>y", "y"), ("&am &amp &quot;", '&am & "'),
    ],
)
def test_small_pages(html, want):
    assert main_text(html, []) == want


def test_steps():
    assert attributes(""" class="b a1" ID='x' data-x=5 hidden """) == {"class": "b a1", "id": "x", "data-x": "5", "hidden": ""}
    assert generalised("div", {"class": "post-12 B a"}) == "div.a.b.post-#"
    assert generalised("div", {"id": "n7"}) == "div.n#" and generalised("p", {}) == "p"
    assert dropped("div", {"class": "siteHeader"}) and dropped("div", {"class": "x comments-area2"}) and dropped("p", {"role": "alert"})
    for name in ("adventure", "header-content", "has-sidebar", "page-with-comments", "gradient", "lead"):
        assert not dropped("div", {"class": name}), name
    page = parse(DIRTY)
    assert page.paths[best_container(page)] == "body>div.layout.with-sidebar>article.post.post-#"


def test_linear_in_hostile_pages():
    for html in ("<a " * 200_000, '<a href="' * 100_001, "<" * 300_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "<p>x" * 100_000, "&amp;" * 200_000, "<b>" * 200_000, '<a b="' + "<p>" * 100_000):
        began = time.time()
        main_text(html, [])
        assert time.time() - began < 10, html[:20]


def test_title_outside_the_container():
    page = f"<body><div class=wrap><div class=logo><h1>Site</h1></div><h1>The title</h1><div class=info>1 May</div><div class=x>{'<p>' + FILL + '</p>'}</div></div>"
    assert main_text(page, []) == "The title " + FILL.strip()
    assert main_text(page.replace("<div class=x>", "<div class=x><h1>Own</h1>"), []) == "Own " + FILL.strip()


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, text string").repartition(2)


def shell(inner, extra=""):
    return f"<body><div class='top'><p>{extra}</p></div><div class='story s1'>{inner}</div></body>"


def test_consensus_reads_a_page_like_its_neighbours(spark, monkeypatch):
    rows = [(i, f"http://A.example/{i}", shell(f"<p>{FILL * 3}{i}</p>", "Welcome, friend of the site.")) for i in range(6)]
    rows.append((6, "http://a.example/6", shell("<p>Short.</p>", FILL * 5)))  # its own best container is the wrong one
    rows.append((7, "http://b.example/7", shell("<p>Short.</p>", FILL * 5)))  # alone on its host
    rows.append((8, "http://a.example/8", f"<body><td>{FILL}</td></body>"))  # of another template
    rows += [(9, None, f"<p>{FILL}</p>"), (10, "no host", None), (None, "http://a.example/6", rows[6][2]), (11, "http://a.example/6", rows[6][2])]
    for most in (4_000_000, 0):
        monkeypatch.setattr(module, "BROADCAST_CHARS", most)
        got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract_main_text(pages_of(spark, rows)).collect()}
        assert len(got) == len(rows) and all(n == len(t) for t, n in got.values())
        text = {k: t for (k, _), (t, _) in got.items()}
        assert text[0] == (FILL * 3).strip() + " 0"
        assert text[6] == text[11] == text[None] == "Short."
        assert text[7] == (FILL * 5).strip() and text[8] == FILL.strip() == text[9] and text[10] == ""
    ranked = {(r.host, r.rank): r.path for r in host_paths(pages_of(spark, rows)).collect()}
    assert ranked["a.example", 1] == "body>div.s#.story"
    assert extract_main_text(pages_of(spark, rows).limit(0)).count() == 0


def test_given_pages_against_a_plain_reading(spark):
    """The given pages have one template: all of <article>, inline tags without a space."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert got[r.page_id] == want
