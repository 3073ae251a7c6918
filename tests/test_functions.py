from html import unescape
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitewise.functions import html as H
from sitewise.functions import text as X
from sitewise.functions import urls as U

NORMAL = [
    (None, ""), ("", ""), ("  ", ""),
    ("http://a.com//x", "http://a.com//x"),
    ("HTTPS://A.com", "https://A.com/"),
    ("https://a.com?q=1#f", "https://a.com/?q=1"),
    ("https://a.com/x;p?q", "https://a.com/x;p?q"),
    ("https://a.com/?#", "https://a.com/"),
    ("a b.com", "https://a b.com/"),
    ("//a.com/x", "https:////a.com/x"),
    ("http:///p", "http:///p"),
    ("HTTP://a.com/Ü?x=#y#z", "http://a.com/Ü?x="),
    ("a.com/\nx", "https://a.com/x"),
    ("https://a.com/x;?q;", "https://a.com/x?q;"),
    ("https://a.com/x;y/z;a;", "https://a.com/x;y/z;a;"),
]


def test_normalize_url(values):
    assert values(U.normalize_url, [a for a, _ in NORMAL]) == [b for _, b in NORMAL]


def test_normalize_url_twice_is_once(values):
    rows = [b for _, b in NORMAL]
    assert values(lambda x: U.normalize_url(U.normalize_url(x)), rows) == rows


def test_domain_key(values):
    suffixes = ["uk", "co.uk", "net", "*.ck", "!www.ck", "ck"]
    cases = {
        "https://shop.acme.co.uk/x": "acme.co.uk",
        "https://m.x.Example.net/": "example.net",
        "https://localhost:8080/": "localhost:8080",
        "https://192.168.0.1/": "192.168.0.1",
        "https://co.uk/": "co.uk",
        "https://u:p@a.b.net:80/": "b.net",
        "https://a.b.net./": "b.net",
        "https://a.b.c.ck/": "b.c.ck",
        "https://a.www.ck/": "www.ck",
        "": "",
    }
    assert values(lambda x: U.domain_key(x, suffixes), list(cases)) == list(cases.values())


HREFS = [
    "/a", "b", "./b", "../b", "../../../b", "?q=1", "//h.org/x", "https://z.org/a/../b",
    "b/./c/../d", "..", ".", "b//c", "/a/../..", "", "x?y=/../z", "/x#frag", "mail:x", "b/..", "/a//b",
]


@pytest.mark.parametrize("base", [
    "https://a.com/", "https://a.com/p/q/r", "https://a.com/p/q/?k=v", "http://a.com/p",
])
def test_resolve_like_the_standard_library(values, base):
    got = values(lambda x: U.resolve(U.url_parts(F.lit(base)), x), HREFS)
    assert got == [urljoin(base, h).partition("#")[0] for h in HREFS]


def test_stable_row_id(values):
    rows = [("example.com", 0), (" Example.COM ", 1), ("", 3), (None, 4)]
    want = ["site_0caaf24ab1a0", "site_0caaf24ab1a0", "row_3", "row_4"]
    assert values(U.stable_row_id, rows, "x string, i long") == want


def test_clean_text(values):
    assert values(X.clean_text, ["a \t b\n\n\n\nc  ", None, " x\r\ny"]) == ["a b\n\nc", "", "x \ny"]


def test_decode_entities(values):
    rows = [
        "a", "&amp;lt; &lt;b&gt; &#39;&#x2014;&#128512;", "&copy 1 &nope; & &;", "&&amp;&",
        "&#38;lt;", "x&middot;y", "&apos;", None,
    ]
    want = [
        "a", "&lt; <b> '—\U0001f600", "&copy 1 &nope; & &;", "&&&", "&lt;", "x·y", "'", None,
    ]
    assert values(X.decode_entities, rows) == want
    assert unescape(rows[1]) == want[1]


def test_full_text(values):
    rows = [
        '<!DOCTYPE html><title>T &amp; u</title><!-- no --><script>var t="</p>";</script>'
        '<style>p{}</style><noscript>N</noscript><p>a<b>b</b>  c\n d</p><template>x</template>',
        '<p title="a>b" class=it\'s>x</p>y<br/>z < 3',
        "", None,
    ]
    got = values(lambda x: H.full_text(H.reduce_html(x)), rows)
    assert got == ["T & u N a b c d", "x y z < 3", "", ""]


def test_metadata(values):
    def head(x):
        r = H.reduce_html(x)
        return F.struct(H.title(r), H.meta_description(r), F.to_json(H.headings(r)))

    many = "".join(f"<h2>h{i}</h2>" for i in range(60))
    rows = [
        '<META content="d" name="Description"><h2>Hi</h2>',
        "<title> A &lt; b </title><meta name='keywords' content='no'><meta name=description content='x &amp; \"y\"'>"
        "<h1>A</h1><h3>a</h3><h2 class=q> B <i>c</i> </h2><!--<h1>no</h1>--><h4>no</h4>",
        many,
    ]
    got = [tuple(v) for v in values(head, rows)]
    assert got[0] == ("", "d", '["Hi"]')
    assert got[1] == ("A < b", 'x & "y"', '["A","B c"]')
    assert got[2][2] == "[" + ",".join(f'"h{i}"' for i in range(50)) + "]"


def test_hrefs(values):
    row = """<a href="/x?a=1&amp;b=2">1</a><A class='q' HREF=' y '>2</A><a name=z>3</a>
    <a data-href="no" href=w>4</a><!--<a href=gone>--><abbr href=no></abbr><a href="">5</a>"""
    assert values(lambda x: H.hrefs(H.reduce_html(x)), [row]) == [["/x?a=1&b=2", "y", "w", ""]]


def _decluttered(x):
    return H.text_lines(H.declutter(H.reduce_html(x)))


def test_declutter_threshold(values):
    short, long = "n" * 399, "n" * 400
    rows = [
        f"<p>a</p><nav>{short}</nav><p>b</p>", f"<p>a</p><nav>{long}</nav>b",
        '<script>x("</p>")</script><p>a</p><noscript>n</noscript>',
        f"<header>{'h' * 175} <nav>{'n' * 100}</nav> {'g' * 175}</header>x",
        # header is shorter than the limit once the nav is gone, but goes by its own text
        f"<header>{'h' * 150}<nav>{'n' * 250}</nav>z</header>x",
    ]
    got = values(_decluttered, rows)
    assert got == [
        "a\nb", f"a\n{long}\nb", "a", f"{'h' * 175}\n{'g' * 175}\nx", f"{'h' * 150}\nz\nx",
    ]


def test_declutter_structure(values):
    rows = [
        "<nav>a<nav>b</nav>c</nav>d",                       # same name nested
        f"<nav>{'q' * 500}<nav>b</nav>c</nav>d",            # outer stays, inner goes
        '<div role="navigation">a<div>b</div>c</div><div>d</div>',   # role on a plain tag
        '<div data-role="navigation">a</div><p role=\'banner\'>b</p>c',
        "x</nav>y",                                         # stray end tag
        "x<nav>y",                                          # never closed
        "<nav>a<form>b</nav>c</form>d",                     # wrong nesting
        "<svg/>a<header-x>b</header-x>",                    # empty element, longer name
        "<NAV>a</NAV>b<head>c</head>",
        "<form>" + "f" * 100 + "<header>" + "h" * 500 + "</header></form>",
        "<nav>" + "n" * 350 + "<noscript>" + "s" * 100 + "</noscript></nav>a",   # no text there
    ]
    want = [
        "d", f"{'q' * 500}\nc\nd", "d", "a\nc", "x\ny", "x", "c\nd", "a\nb", "b\nc",
        "f" * 100 + "\n" + "h" * 500, "a",
    ]
    assert values(_decluttered, rows) == want


def test_main_text_ladder(values):
    def ladder(x):
        return H.main_text(H.declutter(H.reduce_html(x)))

    rows = [
        f"<div>out</div><main><p>{'a' * 201}</p></main>",
        f"<article>{'a' * 200}</article>out",
        f"out<article><p>{'a' * 150}<p>{'b' * 60}</p>tail</article>",
        f"out<div><p>{'a' * 150}<div>no</div><p>{'b' * 60}</p>tail",
        "<div>tiny</div>",
    ]
    assert values(ladder, rows) == [
        "a" * 201, "a" * 200 + "\nout", "a" * 150 + "\n" + "b" * 60 + "\ntail",
        "a" * 150 + "\n" + "b" * 60, "tiny",
    ]


def test_html_filter(values):
    rows = [
        ("text/html; charset=x", 200), ("", 200), (None, 200), ("application/pdf", 200),
        ("text/html", 404), ("Application/XHTML+xml", 200), ("text/html", None),
    ]
    got = values(lambda c, s: H.is_html(s, c), rows, "c string, s int")
    assert got == [True, True, True, False, False, True, False]


def test_js_shell(values):
    def shell(x):
        return H.is_js_shell(x, H.full_text(H.reduce_html(x)))

    rows = ["", None, '<div id="root">' + "a" * 799, '<div ID="root">' + "a" * 800, "<p></p>"]
    assert values(shell, rows) == [True, True, True, False, False]


def test_limits(values):
    got = values(lambda x: F.struct(X.truncate(x, 5), X.over_limit(x, 5), X.utf8_bytes(x)), ["abcde", "abcdéf"])
    assert [tuple(v) for v in got] == [("abcde", False, 5), ("abcdé", True, 7)]


def test_large_page_does_not_overflow(values):
    rows = [
        "<table>" + "<tr><td></td></tr>" * 60_000 + "end", "<a " + "x=1 " * 50_000 + ">t",
        " " * 300_000 + "x", "<script>" * 20_000, "<!--" * 50_000, "\n " * 100_000 + "y",
    ]
    got = values(lambda x: F.length(H.main_text(H.declutter(H.reduce_html(x)))), rows)
    assert got == [3, 1, 1, 0, 0, 1]
