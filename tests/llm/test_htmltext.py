import html
import re

import numpy as np

from tramline.llm import htmltext
from tramline.llm.htmltext import main_text

SF = "/root/testdata/sf0.01"


def brute_article(page):
    """The article of a generated page, cut out by its markers."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body))]
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in htmltext.extracted(pages).collect():
        assert r.text == brute_article(r.html) and r.n_chars == len(r.text)


LONG = "This is a long sentence of the article that goes on for a while, with many words and few tags in it. " * 3


def test_templates():
    around = '<div class="cookie-notice">We use cookies a lot, and tell you so at great length here.</div><nav><a href=1>Home</a></nav>'
    foot = '<div id="comments"><p>First! What a great read this was, thank you so much.</p></div><aside>More stories for you to read</aside><footer>(c)</footer>'
    want = "\n".join([LONG.strip(), "Short.", LONG.strip()])
    body = f"<p>{LONG}<p>Short.</p><script>if (a<b) '</p>'</script><div class='ad banner'>Buy now</div><p>{LONG}</p>"
    for page in (
        f"<html><body>{around}<article>{body}</article>{foot}</body></html>",
        f"<html><body>{around}<main><div>{body}</div></main>{foot}",
        f"{around}<div id=content>{body}</div>{foot}",
        f"<header><h1>Site</h1><p>{LONG}</p></header>{around}<div><div class='post'>{body}</div></div><form><p>{LONG}</p></form>{foot}",
        f"<div class='notice'>left open<article>{body}</article>{foot}",
        f"<article>{body}<section class='comments'><article>{LONG}</article></section></article>{foot}",
    ):
        assert main_text(page) == want, page
    assert main_text(f"<article><header><h1>T &amp; é&#233;</h1></header><p>a<br>b <b>c</b>\n\n d</p><p> </p><p>{LONG}</p></article>").startswith("T & éé\na b c d\n")
    assert main_text("plain text only") == "plain text only" and main_text("<p>a &lt;b&gt; &am") == "a <b> &am"


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "<p>x</p>"), (3, "u", "<nav>only menu</nav>"), (4, "u", "<" * 500), (5, "u", "<div>" * 3000 + "deep" + "</b>" * 50), (6, "u", f"<article><p>{'word ' * 100000}</p></article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extracted(pages).collect()}
    assert got[1] == got[2] == got[3] == "" and got[None] == "x" and got[5] == "deep" and len(got[6]) == 499999
    assert htmltext.extracted(pages).count() == 8 and htmltext.extracted(pages.limit(0)).count() == 0


def _div(page):
    return page.replace("<article>", '<div class="post">').replace("</article>", "</div>")


def _bare(page):
    return re.sub(r"<(/?)(nav|footer)>", r"<\1div>", _div(page)).replace(' class="ad"', "")


def _with_links(page):
    return page.replace("</article>", "<ul>" + "".join(f'<li><a href="/{n}">More {n}</a></li>' for n in range(9)) + "</ul></article>")


def test_ratios_select_the_regions(spark, monkeypatch):
    """Against the generated articles: without an article element, without any telling name, and with a menu inside."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]

    def right(change):
        return np.mean([main_text(change(h)) == brute_article(h) for h in pages])

    assert right(_div) == 1 and right(_with_links) == 1
    bare = right(_bare)
    assert bare > 0.8
    monkeypatch.setattr(htmltext, "content_lines", lambda ratios, sigma=1.0: np.ones(len(ratios), bool))
    assert right(_with_links) == 0 and right(_bare) < bare - 0.2


def test_names_inside_and_around():
    body = f"<p>{LONG}</p><p>Short.</p>"
    want = f"{LONG.strip()}\nShort."
    for page in (
        f'<article><h1 class="page-header">H</h1>{body}</article>',
        f'<article><div class="entry-header">H</div>{body}</article>',
        f'<article><p class="search-term">H</p>{body}</article>',
        f'<div class="layout has-sidebar"><h2>H</h2>{body}</div>',
        f'<form><main><h2>H</h2>{body}</main></form>',
        f'<form><div><h2>H</h2>{body}</div></form>',
        f'<body class="comments-open"><article><section id="related-work"><h2>H</h2>{body}</section></article>',
        f'<article><h2>H</h2>{body}<p class="ad">Buy<p class="cookieNotice">We use them</article>',
        f'<article><h2>H</h2><p class="ad">Buy{body}</article>',
        f'<ul><li class="nav-item">A<li class="nav-item">B</ul><article><h2>H</h2>{body}</article>',
        f'<article><h2>H</h2><table><tr><td class="ad">Buy<td>{LONG}<tr><td>Short.</table></article>',
        f'<article><h2>H</h2><a href=x>{body}<a href=y></a></article><div class="comment-list"><p>{LONG * 9}</p></div>',
    ):
        assert main_text(page) == f"H\n{want}", page


def test_unfinished_pages_take_linear_time():
    import time

    for part, most in (("<a ", 0), ("<!--", 0), ('<a href="', 0), ('<a href="x>', 0), ("<![CDATA[", 0), ("<?", 0), ("<script></", 0), ("</a", 0), ("<p><b><p>", 0), ("<li>a", 10**6), ("<", 10**6), ("&", 10**6)):
        began = time.process_time()
        assert len(main_text(part * 20_000)) <= most
        assert time.process_time() - began < 10, part
    assert main_text(f'<p>{LONG}</p><a href="open>x</a><p>{LONG}</p>') == f"{LONG.strip()}\n{'x'}\n{LONG.strip()}"
    assert main_text(f"<p>{LONG}</p><!-- left open <p>x</p>") == LONG.strip()


def test_smoothing():
    values = np.array([0.0, 0, 10, 0, 0])
    weights = np.exp(-np.arange(-3, 4) ** 2 / 2)
    assert np.isclose(htmltext.smoothed(values)[2], 10 * weights[3] / weights[1:6].sum())
    assert htmltext.content_lines(np.array([50.0, 60, 55, 1, 1, 1])).tolist() == [True, True, True, False, False, False]


def test_controls_inside_a_line_do_not_end_it(spark):
    body = "<p>Press <button>OK</button> now, or <select><option>a<option>b</select>wait <span class='ad'>Buy this</span> here <script>x()</script>for it.</p><p>Another line of text follows here.</p>"
    left_open = "<div><span class='notice'>Cookies <article><p>The article's own words stand here.</p></article></div>"
    rows = [(1, "u", f"<html><body><article>{body}</article></body></html>"), (2, "u", f"<html><body>{left_open}</body></html>")]
    got = {r.page_id: r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Press now, or wait here for it.\nAnother line of text follows here."
    assert got[2] == "The article's own words stand here."
