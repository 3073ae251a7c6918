import html
import re
import time

import pytest

from sitewise.llm.html_extract import extract_pages, main_text

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>'
LONG = "A sentence of the article which says a little more than nothing at all, and then goes on. " * 2


@pytest.mark.parametrize("page,want", [
    (f"<html><body>{MENU}<div class='ad'>Buy now, buy cheap, buy more of it here.</div><article><h1>T &amp; t</h1><p><b>One<br>two\n three<p>Four.</p>"
     "<aside>Beside</aside><div class=comments><p>First!</p></div></article><footer>&copy; x</footer>", ["T & t", "One two three", "Four."]),
    (f"<body>{MENU}<div id=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>"
     f"<div id='comments'><p>{LONG}</p></div>{MENU}</body>", ["Head", LONG.strip(), "Short.", LONG.strip()]),
    ("<article><p>a < b &lt;c&gt;</p><script>if (a<b) '</p>'</script><!-- <p>no</p> --><p>d", ["a < b <c>", "d"]),
    ("", []), ("no markup at all", ["no markup at all"]), ("<p>x<ta", ["x"]), ("<style>p{}", []),
    ("<main><ul><li>one<li>two</ul></main>", ["one", "two"]),
    ("<p title=it's>Hello world first paragraph.</p><p>Second isn't para.</p><p>third</p>", ["Hello world first paragraph.", "Second isn't para.", "third"]),
    ("<p title=it's>Hello there.</p><p>third</p>", ["Hello there.", "third"]), ('<p class="foo>One.</p><p>Two.</p>', ["One.", "Two."]),
    ("<article><p data-x='a>b' id = \"c>d\" title=x=\"y>One.</p><img alt=\"a > b\" src=x/><p \"odd'>Two.</p></article>", ["One.", "Two."]),
])
def test_pages(page, want):
    assert main_text(page) == "\n\n".join(want)


def test_whole_table_against_the_marked_article(spark):
    """In the test pages the article's blocks are all headings and paragraphs in <article>."""
    rows = extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r.html)[1]
        body = re.sub(r"<br>", " ", re.sub(r"</?b>", "", body))
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b), r.page_id
        assert r.n_chars == len(r.text)


def test_cases(spark):
    pages = spark.createDataFrame([(1, None, "u"), (1, None, "u"), (2, "<p>x</p>", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in extract_pages(pages).collect()) == ["", "", "x"]
    assert extract_pages(pages.limit(0)).count() == 0


def test_linear_time():
    def took(n):
        start = time.time()
        main_text("<article>" + "<p>word<b>" * n)
        return time.time() - start

    took(1000)
    assert took(40_000) < 8 * max(took(10_000), 0.02)


@pytest.mark.parametrize("page,want", [
    # A mark elsewhere neither hides the body nor keeps the comments.
    (f"<div id=content><h2>Head</h2><p>{LONG}</p></div><article class='comment'><p>{LONG} No.</p></article>", ["Head", LONG.strip()]),
    (f"<div id=content><p>{LONG}</p></div><article class=post><p>Teaser.</p></article>", [LONG.strip(), "Teaser."]),
    (f"<article class='post comments-open'><p>{LONG}</p></article>", [LONG.strip()]),
    # Lines of links between surge and dive, headings in links, short opening lines.
    (f"<div><p>{LONG}</p><p><a href=x>See the other one</a></p><p>{LONG}</p></div>", [LONG.strip(), "See the other one", LONG.strip()]),
    (f"<div><h1><a href=x>Head</a></h1><p>By me</p><p>Today</p><p>Now</p><p>{LONG}</p></div>", ["Head", "By me", "Today", "Now", LONG.strip()]),
])
def test_sums_decide(page, want):
    assert main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("page,want", [
    ("<head><title>t</title><body><article><p>x</article>", ["x"]),
    ("<head><meta charset=utf-8><title>t</title><article><p>x</article>", ["x"]),
    ("<article><table><tr><td class=ad>Buy<td>x<tr class=ad><td>Buy<tr><td>y</table></article>", ["x", "y"]),
    ("<article><dl><dt>a<dd class=ad>Buy<dt>b<dd>c</dl><ul><li class=ad>Buy <b>it<li>d</ul></article>", ["a", "b", "c", "d"]),
])
def test_end_tags_left_out(page, want):
    assert main_text(page) == "\n\n".join(want)


def test_quotes_never_closed_take_linear_time():
    start = time.time()
    text = main_text("<article>" + "<p title=it's class='a>word " * 20_000 + "</article>")
    assert "word" in text and time.time() - start < 10
