import html
import re
import time

import pytest

from lexframe.llm.html_blocks import extract_main_text, main_text, surges

PARAGRAPH = "A paragraph with enough words in it to be taken for the main text of a page, not for a link."


def test_articles_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_main_text(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain", "plain"), ("<p>a &amp b &#x41; &nbsp; c</p>", "a & b A c"), ("<!-- never closed", ""),
    ("<script>if (a < b) '</p>'", ""), ("<p>one<br>two</p>", "one\ntwo"), ("<b>x</b>y <i>z", "xy z"),
    (f"<nav>menu</nav><h1>T</h1><p>{PARAGRAPH}<p>short<div class='ad-box'>buy</div><p>end</p><footer>f</footer>",
     f"T\n{PARAGRAPH}\nshort\nend"),
    (f"<ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul><p>{PARAGRAPH}</p><hr><div id=comments><p>{PARAGRAPH}</div>",
     PARAGRAPH),
    (f"<div>{PARAGRAPH}</div><main><p>Short.</p><aside>x</aside><article class=comment>no</article></main>", "Short."),
    ("<form><p>name</p></form><div role=navigation>x</div><p hidden>h</p><p>kept</p>", "kept"),
    ("<a title='1 > 0'>linked</a> text", "linked text"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_surges_and_dives():
    assert surges([0, 0, 50, 90, 5, 0, 5, 0, 0, 0, 0, 10, 0, 0, 0], 3, 86) == [(2, 7)]
    assert surges([], 3, 86) == [] and surges([0, 0], 3, 86) == []


def test_long_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, f"<p>{PARAGRAPH}</p>" * 20_000), (3, "<p>x"), (None, "<p>x")]
    out = extract_main_text(spark.createDataFrame(rows, "text bigint, html string")).collect()
    assert [r["n_chars"] for r in out] == [0, 0, 20_000 * (len(PARAGRAPH) + 1) - 1, 1, 1]
    assert extract_main_text(spark.createDataFrame([], "html string")).count() == 0


LINKS = "".join(f"<li><a href=/{k}>Read more about {k}</a>" for k in range(6))


def test_links_inside_a_marked_article_dive():
    page = f"<article><h1>T</h1><p>{PARAGRAPH}</p><ul>{LINKS}</ul><p>{PARAGRAPH}</p></article>"
    assert main_text(page) == f"T\n{PARAGRAPH}\n{PARAGRAPH}"
    page = f"<main><p>{PARAGRAPH}</p><ul>{LINKS}</ul><p>More here</p><ul>{LINKS}</ul></main>"
    assert main_text(page) == f"{PARAGRAPH}\nMore here"
    page = f"<article><h1>T</h1><p>Short.</p><ul>{LINKS}</ul><p>Short last.</p></article>"
    assert main_text(page) == "T\nShort.\nShort last."


LONG = f"{PARAGRAPH} {PARAGRAPH}"


@pytest.mark.parametrize("page, text", [
    (f"<div class='layout has-sidebar'><article><p>{PARAGRAPH}</p></article></div>", PARAGRAPH),
    (f"<div class='content no-sidebar'><p>{PARAGRAPH}</p><div class=ad>buy</div></div>", PARAGRAPH),
    (f"<form><nav>menu</nav><main><p>{PARAGRAPH}</p></main><p>x</p></form>", PARAGRAPH),
    (f"<form><p>{PARAGRAPH}</p><div class=sidebar>x</div></form>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</p><section id='discussion'><p>{LONG}</p></section></article>", PARAGRAPH),
    (f"<article><div class='notice'><p>{LONG}</p></div><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</p><p class='social-policy'>{LONG}</p></article>", f"{PARAGRAPH}\n{LONG}"),
    (f"<article><p>{PARAGRAPH}</p><div class='share'>Share this</div></article>", PARAGRAPH),
])
def test_one_word_of_a_class_silences_no_text(page, text):
    assert main_text(page) == text


NAMED = ["section class=comments", "div class='cookie-notice'", "div class=ad", "div class='ad slot-3'", "div id=sidebar",
         "div class=commentList", "form", "fieldset", "div class='site-footer'", "ul class='related-posts'"]


@pytest.mark.parametrize("start", NAMED)
@pytest.mark.parametrize("page", [
    "<article><h1>T</h1><p>{text}</p>{block}</article>", "<article><h1>T</h1>{block}<p>{text}</p></article>",
    "<article><h1>T</h1><p>{text}</p></article>{block}", "<div><h1>T</h1><p>{text}</p><p>{text}</p><p>{text}</p>{block}</div>",
])
def test_named_blocks_are_left_out_whole(start, page):
    block = f"<{start}><div><p>{LONG}</p></div></{start.split()[0]}>"
    times = page.count("{text}")
    assert main_text(page.format(text=PARAGRAPH, block=block)) == "\n".join(["T"] + [PARAGRAPH] * times)


def test_comments_longer_than_an_unmarked_article_go():
    comments = f"<div id=comments>{f'<p>{LONG}</p>' * 9}</div>"
    assert main_text(f"<h1>T</h1><p>{PARAGRAPH}</p>{comments}") == f"T\n{PARAGRAPH}"
    assert main_text(f"<div class=comments><h1>T</h1><p>{PARAGRAPH}</p></div>") == f"T\n{PARAGRAPH}"
    assert main_text(f"<article><div class=widget><p>{PARAGRAPH}</p></div></article>") == PARAGRAPH


def test_articles_are_found_without_their_marks(spark, sf_dir):
    """The windows alone, on the pages of the tables with ``article`` renamed."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        plain = re.sub("(</?)article", r"\1div", r["html"])
        assert main_text(plain) == main_text(r["html"])


def test_inline_boilerplate_leaves_the_rest_of_its_line():
    assert main_text("<p>one <span hidden>two</span> three</p>") == "one three"


@pytest.mark.parametrize("page, text", [
    ("x &#" + "9" * 5000 + "; y", "x \ufffd y"), ("x &#" + "0" * 5000 + "65; y", "x A y"), ("x &#x" + "f" * 9000 + " y", "x \ufffd y"),
    ('<p>one<p title="2>two<p>three', "one\ntwo\nthree"), ("1 < 2 <b", "1 < 2 <b"),
])
def test_broken_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("piece", [
    "<a ", "<i>", "<i><b></b>", "<div><b></i>", '<a ">"', "<a '\">", "<svg/>", "<!", "<p class=\"", "&#", "<form>", "<div class=ad>",
    "</i>", "<table><tr><td>", "<article><h1>",
])
def test_a_megabyte_of_odd_markup(piece):
    for tail in ("<p>x</p>", '"'):
        page = piece * (1_000_000 // len(piece)) + tail
        at = time.process_time()
        main_text(page)
        assert time.process_time() - at < 4
