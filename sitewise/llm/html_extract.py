"""Main text of web pages by line-block distribution.

Method: strip the markup, so that the page becomes lines (blocks); sum text lengths over sliding
windows of lines; find the surge, where the sums rise above a threshold, and the dive, where
they fall back to nothing; keep the lines between them. Lengths count a line's own prose only:
text in links is no content, so menus stay flat.

Regions which say what they are help the distribution. Elements for menus, headers, footers,
sidebars, forms, scripts and styles, and elements whose class, id or role names such a thing
(advert, notice, cookie banner, comments and so on) are stripped with their markup. Where the
page marks its article (<article>, <main>, role=main, itemprop=articleBody), each line of that
region weighs as much as a surge at least, so that one-word paragraphs inside it stay. Lines outside the mark are judged by their own
sums, and the two kinds never share a window: a short line beside the region is not drawn in.

One pass per page, linear in its length; no shuffle. Pages are independent of each other.

Defined cases: null, empty and text-free html give an empty text; truncated markup and unclosed
elements end at the end of the page; a tag without end is dropped; repeated rows are extracted
each; empty tables work; other columns are kept, those named like an output give way.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements which are never content, with all they hold.
NOISE = frozenset(
    "nav header footer aside form script style noscript template iframe svg canvas button select "
    "option textarea input label dialog menu object embed audio video map head title".split()
)
#: Raw text: no markup inside.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inside these a line goes on.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebars?|side|footer|header|masthead|"
    r"comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|newsletter|subscribe|signup|"
    r"share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|skip|login|search|legal|copyright|disclaimer|"
    r"hidden|noprint)(?:$|[\s_-])",
    re.I,
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in <head>; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noscript script style template title".split())
#: Elements whose end tag may be missing, by the start tags which end them.
_ITEM, _TERM, _CELL, _ROWS = {"li"}, {"dd", "dt"}, {"td", "th"}, {"thead", "tbody", "tfoot", "caption", "colgroup"}
ENDS = {
    "li": _ITEM, "dd": _TERM, "dt": _TERM, "td": _CELL | {"caption"}, "th": _CELL | {"caption"}, "tr": _CELL | {"tr", "caption", "colgroup"},
    **{t: _CELL | _ROWS | {"tr"} for t in _ROWS}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote opens a value only after "="; a value without its closing quote ends at ">".
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|=)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|["']?[^\s>"'][^\s>]*|["']?))?""")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, value in _ATTR.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _is_noise(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOISE:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        # Whole names only: an article's class may tell of its comments ("comments-open").
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        return "hidden" in attrs or any(NOISE_NAME.fullmatch(re.sub(r"[-_]?\d+$", "", n)) for n in names)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in NOISE_ROLE:
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return any(NOISE_NAME.search(attrs.get(a, "")) for a in ("class", "id"))


def _is_article(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody"


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, in a marked article) of each line, in page order."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    prose = at = 0
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, noise, article, link, heading
    noise = article = link = heading = 0
    opened: Counter[str] = Counter()

    def end_line():
        nonlocal prose
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            lines.append((text, prose, article > 0))
        parts.clear()
        prose = 0

    def say(text: str):
        nonlocal prose
        if text and stack and stack[-1][0] == "head" and not text.isspace():
            pop()
        if text and not noise:
            parts.append(text)
            if not link or heading:
                prose += len(text)

    def push(tag, attrs):
        nonlocal noise, article, link, heading
        marks = (tag, _is_noise(tag, attrs), _is_article(tag, attrs), tag == "a", tag in HEADINGS)
        noise, article, link, heading = noise + marks[1], article + marks[2], link + marks[3], heading + marks[4]
        opened[tag] += 1
        stack.append(marks)

    def pop():
        nonlocal noise, article, link, heading
        tag, n, a, k, h = stack.pop()
        noise, article, link, heading = noise - n, article - a, link - k, heading - h
        opened[tag] -= 1

    def end_open(tag):
        """End what ``tag`` follows without an end tag: cells and rows of this table, items of this list."""
        ends = ENDS[tag]
        if not any(opened[t] for t in ends):
            return
        last = None
        for k in range(len(stack) - 1, -1, -1):
            own = stack[k][0]
            if own in ends:
                last = k
                if tag in ("li", "dd", "dt"):
                    break
            elif own == "table" or (tag in ("li", "dd", "dt") and own not in INLINE and own not in ("p", "div", "address")):
                break
        while last is not None and len(stack) > last:
            pop()

    size = len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            # A '<' which opens nothing is text; an open tag at the very end is dropped.
            if re.match(r"</?[a-zA-Z]", page[lt:lt + 3]) and ">" not in page[lt:]:
                break
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if not m[1] and tag not in IN_HEAD and stack and stack[-1][0] == "head":
            pop()
        if m[1]:
            if block:
                end_line()
            if opened[tag]:
                while stack:
                    top = stack[-1][0]
                    pop()
                    if top == tag:
                        break
            continue
        if tag == "br":
            say(" ")
            continue
        if block:
            end_line()
        if tag in VOID:
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        # A block ends an open paragraph, and what inline elements it left open.
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in ENDS:
            end_open(tag)
        push(tag, attrs)
    end_line()
    return lines


def main_lines(lines: list[tuple[str, int, bool]], window: int = 3, surge: int = 120) -> list[str]:
    """The lines between surges and dives of the window sums.

    A run of lines starts where the sum of ``window`` lines reaches ``surge`` characters, and back over
    the lines of text which lead there; it ends with its last line of text before the sum has fallen to nothing, and keeps
    every line between. Lines of a marked article have at least the weight of a surge; marked and
    unmarked stretches have windows of their own.
    """
    if not lines:
        return []
    # Mostly links: nothing, but for a long share of prose.
    weights = [max(n, surge) if a else n if n >= min(len(t) / 2, surge / 2) else 0 for t, n, a in lines]
    stretches = [[i for i, _ in own] for _, own in itertools.groupby(enumerate(lines), lambda x: x[1][2])]
    sums = []
    for own in stretches:
        w = np.array([weights[i] for i in own], float)
        sums.append(np.convolve(w, np.ones(window))[window - 1:])  # each line and those after it
    if not any(a for _, _, a in lines):
        surge = min(surge, sums[0].max() / 2)  # a short page has a low surge
    kept = []
    for own, total in zip(stretches, sums, strict=True):
        at = free = 0  # free: the first line no run has taken
        while at < len(own):
            if weights[own[at]] == 0 or total[at] < surge:
                at += 1
                continue
            start = last = at
            while start > free and weights[own[start - 1]] > 0:
                start -= 1
            while at < len(own) and total[at] > 0:
                last = at if weights[own[at]] > 0 else last
                at += 1
            kept += [lines[i][0] for i in own[start:last + 1]]
            free = at
    return kept


def main_text(page: str | None, window: int = 3, surge: int = 120) -> str:
    return "\n\n".join(main_lines(lines_of(page or ""), window, surge))


def extract_pages(pages: DataFrame, html: str = "html", window: int = 3, surge: int = 120) -> DataFrame:
    """``pages`` with text and n_chars."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: main_text(x, window, surge))

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*kept, text(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
