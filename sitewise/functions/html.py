"""HTML columns: text, metadata, headings, anchors and clutter removal.

Everything is a built-in column expression over one page, so that extraction
is a narrow stage and the HTML itself never enters a shuffle.  Patterns use
possessive loops: they run in linear time and constant stack on large pages.

The markup is first *reduced* (comments, scripts, styles and templates out)
and all other columns start from the reduced form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions.text import clean_text, collapse, decode_entities, let, strip

# Text nodes are parted by this mark while they are worked on.
MARK = "\x01"

# From the tag name to the closing '>', minding '>' inside quoted values.
_TAG_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
TAG = r"<[a-zA-Z/!?]" + _TAG_REST
_HIDDEN = (
    r"<(?:!--.*?(?:-->|\z)"
    r"|s(?:cript(?:[\s/]" + _TAG_REST + r"|>).*?(?:</script\s*>|\z)"
    r"|tyle(?:[\s/]" + _TAG_REST + r"|>).*?(?:</style\s*>|\z))"
    r"|template(?:[\s/]" + _TAG_REST + r"|>).*?(?:</template\s*>|\z))"
)
_ATTRIBUTE = r"""(?s)[^\s=>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
_BLOCK = (
    "p|div|section|article|main|aside|header|footer|nav|form|ul|ol|dl|table|"
    "blockquote|pre|figure|h[1-6]|hr|body|html"
)


def reduce_html(html: Column) -> Column:
    """Drop comments and the bodies of script, style and template."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)" + _HIDDEN, MARK)


def _nodes(markup: Column) -> Column:
    """Text of reduced markup, with a mark wherever a tag stood."""
    return decode_entities(F.regexp_replace(markup, TAG, MARK))


def joined_text(markup: Column, separator: str) -> Column:
    """Stripped, non-empty text nodes with a separator between them."""
    # A run of blanks is tried from its first blank only.
    seam = rf"(?U)(?:\s(?<!\s\s)\s*+)?{MARK}[\s{MARK}]*+"
    return strip(F.regexp_replace(_nodes(markup), seam, separator))


def full_text(reduced: Column) -> Column:
    """Every text node of the document on one line."""
    return collapse(F.regexp_replace(_nodes(reduced), MARK, " "))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one start tag; null if it is absent."""
    pairs = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    own = F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)) == name)
    raw = F.regexp_replace(F.get(own, F.lit(0)), r"^[^\s=]+\s*=\s*", "")
    return decode_entities(F.regexp_replace(raw, r"^[\"']|[\"']$", ""))


def title(reduced: Column) -> Column:
    return strip(decode_entities(
        F.regexp_extract(reduced, r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1)
    ))


def meta_description(reduced: Column) -> Column:
    """Content of the first meta element named description; '' if none."""
    tags = F.regexp_extract_all(reduced, F.lit(r"(?is)<meta[\s/]" + _TAG_REST), F.lit(0))
    named = F.filter(tags, lambda t: F.lower(attribute(t, "name")) == "description")
    return strip(F.coalesce(attribute(F.get(named, F.lit(0)), "content"), F.lit("")))


def headings(reduced: Column, limit: int = K.MAX_HEADINGS) -> Column:
    """h1 to h3 texts in document order, first seen per lower-case form."""
    inner = F.regexp_extract_all(
        reduced, F.lit(r"(?is)<(h[1-3])(?:\s[^>]*+)?>(.*?)</\1\s*>"), F.lit(2)
    )
    texts = F.filter(F.transform(inner, full_text), lambda t: t != "")

    def first_seen(found: Column) -> Column:
        return let(
            F.transform(found, F.lower),
            lambda keys: F.filter(
                found, lambda t, i: F.array_position(keys, F.lower(t)) == (i + 1).cast("bigint")
            ),
        )

    return F.slice(let(texts, first_seen), 1, limit)


def hrefs(reduced: Column) -> Column:
    """Every anchor's href in document order, stripped."""
    tags = F.regexp_extract_all(reduced, F.lit(r"(?is)<a\s" + _TAG_REST), F.lit(0))
    values = F.transform(tags, lambda t: attribute(t, "href"))
    return F.transform(F.filter(values, lambda v: v.isNotNull()), strip)


def is_followable(href: Column) -> Column:
    """Not empty and not one of the skipped forms; case matters."""
    starts = "|".join(K.SKIPPED_HREF_STARTS)
    return (href != "") & ~href.rlike(f"^(?:{starts})")


_OPEN = "array<struct<name:string,seg:int,base:bigint,clutter:boolean,never:boolean>>"
_CUTS = "array<struct<lo:int,hi:int>>"


def declutter(reduced: Column, limit: int = K.CLUTTER_CHARS) -> Column:
    """Markup without noscript and without clutter elements under ``limit``.

    An element goes by the length of its own original text, so the order of
    judging does not matter.  The markup is cut at the tags which open or close
    a clutter element, and one fold over these few pieces keeps the stack of
    open elements; this gets nesting, stray end tags and elements that are never
    closed right.  Elements with a clutter role take part under their own name.
    """
    roles = "|".join(K.CLUTTER_ROLES)
    role_attr = (
        rf"(?s)^<[^>]*?\s(?i:role)\s*=\s*(?:\"(?:{roles})\"|'(?:{roles})'|(?:{roles})(?=[\s/>]))"
    )
    fixed = "|".join(("noscript", *K.CLUTTER_TAGS))

    def pieces(markup: Column) -> Column:
        tags_with_role = F.when(markup.rlike(r"[rR][oO][lL][eE]\s*="), F.filter(
            F.regexp_extract_all(markup, F.lit(r"(?is)<[a-z][^>]*?\srole\s*=[^>]*+>"), F.lit(0)),
            lambda t: t.rlike(role_attr),
        )).otherwise(F.array().cast("array<string>"))
        names = F.array_distinct(F.transform(
            tags_with_role, lambda t: F.lower(F.regexp_extract(t, r"^<([a-zA-Z0-9-]+)", 1))
        ))
        wanted = F.concat_ws("|", F.lit(fixed), names)
        cutter = F.concat(F.lit("(?i)(?=</?(?:"), wanted, F.lit(r")[\s/>])"))
        return F.transform(F.split(markup, cutter), described)

    def described(html: Column, i: Column) -> Column:
        tag = F.regexp_extract(html, "^" + TAG, 0)
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z0-9-]+)", 1))
        return F.struct(
            html.alias("html"),
            i.alias("seg"),
            name.alias("name"),
            tag.startswith("</").alias("closes"),
            ((name != "") & ~tag.startswith("</") & ~tag.endswith("/>")).alias("opens"),
            (name.isin(*K.CLUTTER_TAGS) | tag.rlike(role_attr)).alias("clutter"),
            (name == "noscript").alias("never"),
        )

    def text_size(html: Column) -> Column:
        """Length of the text with one separator more, 0 if there is none."""
        return let(
            F.length(joined_text(html, " ")), lambda n: F.when(n > 0, n + 1).otherwise(0)
        )

    def cuts_of(closed: Column, total: Column, hi: Column) -> Column:
        short = F.filter(closed, lambda e: e.never | (e.clutter & (total - e.base - 1 < limit)))
        return F.transform(short, lambda e: F.struct(e.seg.alias("lo"), hi.alias("hi")))

    def closed_by(state: Column, piece: Column) -> Column:
        """How many open elements this piece's end tag closes; 0 if it is stray."""
        return F.when(
            piece.closes,
            F.array_position(F.reverse(F.transform(state.open, lambda e: e["name"])), piece["name"]),
        ).otherwise(F.lit(0)).cast("int")

    def step(state: Column, piece: Column) -> Column:
        return let(closed_by(state, piece), lambda depth: let(
            F.slice(state.open, F.lit(1), F.size(state.open) - depth),
            lambda still_open: moved(state, piece, depth, still_open),
        ))

    def moved(state: Column, piece: Column, depth: Column, still_open: Column) -> Column:
        entered = F.array(F.struct(
            piece["name"].alias("name"), piece.seg.alias("seg"), state.total.alias("base"),
            piece.clutter.alias("clutter"), piece.never.alias("never"),
        ))
        # Text outside of all clutter, most of a page, is not measured; noscript is no text.
        hidden = (piece.opens & piece.never) | F.exists(still_open, lambda e: e.never)
        counts = (piece.opens & piece.clutter) | F.exists(still_open, lambda e: e.clutter)
        size = F.when(counts & ~hidden, text_size(piece.html)).otherwise(F.lit(0)).cast("bigint")
        closed = F.slice(state.open, F.size(still_open) + 1, depth)
        return F.struct(
            F.when(piece.opens, F.concat(still_open, entered))
            .otherwise(still_open).cast(_OPEN).alias("open"),
            (state.total + size).alias("total"),
            F.when(depth > 0, F.concat(state.cuts, cuts_of(closed, state.total, piece.seg)))
            .otherwise(state.cuts).cast(_CUTS).alias("cuts"),
        )

    def keep(parts: Column) -> Column:
        start = F.struct(
            F.array().cast(_OPEN).alias("open"),
            F.lit(0).cast("bigint").alias("total"),
            F.array().cast(_CUTS).alias("cuts"),
        )
        cuts = F.aggregate(
            parts, start, step,
            lambda s: F.concat(s.cuts, cuts_of(s.open, s.total, F.size(parts))),
        )
        return let(cuts, lambda found: F.when(F.size(found) == 0, F.array_join(F.transform(parts, lambda p: p.html), "")).otherwise(
            let(joined(found), lambda spans: F.array_join(F.transform(between(parts, spans), lambda p: p.html), ""))
        ))

    def joined(found: Column) -> Column:
        """Cuts which touch or hold each other as one, in order."""
        start = F.struct(F.array().cast(_CUTS).alias("done"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

        def add(s: Column, c: Column) -> Column:
            return F.when(c.lo <= s.hi, F.struct(
                s.done.alias("done"), s.lo.alias("lo"), F.greatest(s.hi, c.hi).alias("hi")
            )).otherwise(F.struct(ended(s).alias("done"), c.lo.alias("lo"), c.hi.alias("hi")))

        def ended(s: Column) -> Column:
            last = F.array(F.struct(s.lo.alias("lo"), s.hi.alias("hi")))
            return F.when(s.lo >= 0, F.concat(s.done, last)).otherwise(s.done).cast(_CUTS)

        return F.aggregate(F.array_sort(found), start, add, ended)

    def between(parts: Column, spans: Column) -> Column:
        """What the cuts leave: each piece is looked at once, however many cuts there are."""
        def gap(j: Column) -> Column:
            begin = F.when(j > 0, F.get(spans, j - 1)["hi"]).otherwise(F.lit(0))
            end = F.coalesce(F.get(spans, j)["lo"], F.size(parts))
            return F.slice(parts, begin + 1, F.greatest(end - begin, F.lit(0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), gap))

    return let(reduced, lambda markup: let(pieces(markup), keep))


def text_lines(markup: Column) -> Column:
    """Cleaned text, one text node per line."""
    return clean_text(joined_text(markup, "\n"))


def region_text(decluttered: Column) -> Column:
    """Text from the first start to the last end of main, else of article."""
    def span(name: str) -> Column:
        return F.regexp_extract(decluttered, rf"(?is)<{name}(?:\s[^>]*+)?>(.*)</{name}\s*>", 1)

    return text_lines(F.coalesce(F.nullif(span("main"), F.lit("")), span("article")))


def paragraph_text(decluttered: Column) -> Column:
    """Text of all paragraphs; a paragraph ends at the next block tag."""
    parts = F.split(decluttered, r"(?i)<p(?=[\s/>])")
    starts = F.slice(parts, F.lit(2), F.size(parts))
    bodies = F.transform(
        starts,
        lambda p: F.regexp_replace(
            F.concat(F.lit("<p"), p), rf"(?is)(?<=.)</?(?:{_BLOCK})(?=[\s/>]).*", ""
        ),
    )
    texts = F.filter(F.transform(bodies, text_lines), lambda t: t != "")
    return F.array_join(texts, "\n")


def densest_block(decluttered: Column) -> Column:
    """Text of the run of blocks with the most prose in it, see :func:`densest_run`."""
    return densest_run(decluttered)["text"]


def densest_run(decluttered: Column) -> Column:
    """The run of blocks with the most prose in it, as a struct of its ``text`` and ``markup``.

    The page is cut at block tags. A block weighs its characters, less three for each which is in a link
    and less a fixed toll, so prose counts for and menus and scraps against; the run of blocks with the
    largest sum of weights wins, the first of equals, found in one fold over the blocks. A run begins
    anew where the sum before it is not above 0.
    """
    def described(piece: Column) -> Column:
        anchors = F.regexp_extract_all(piece, F.lit(r"(?is)<a\s[^>]*+>(.*?)</a\s*>"), F.lit(1))
        linked = F.when(F.size(anchors) > 0, F.length(text_lines(F.array_join(anchors, " ")))).otherwise(0)
        return let(text_lines(piece), lambda t: F.struct(
            t.alias("text"), (F.length(t) - K.LINK_WEIGHT * linked - K.BLOCK_TOLL).cast("bigint").alias("weight"), piece.alias("markup")
        ))

    def step(s: Column, b: Column) -> Column:
        fresh = s["sum"] <= 0
        total = F.when(fresh, b["weight"]).otherwise(s["sum"] + b["weight"])
        start = F.when(fresh, b["n"]).otherwise(s["start"])
        return let(F.struct(total.alias("sum"), start.alias("start")), lambda run: let(
            s["best"].isNull() | (run["sum"] > s["best"]), lambda better: F.struct(
                run["sum"].alias("sum"), run["start"].alias("start"),
                F.when(better, run["sum"]).otherwise(s["best"]).alias("best"),
                F.when(better, run["start"]).otherwise(s["first"]).alias("first"),
                F.when(better, b["n"]).otherwise(s["last"]).alias("last"),
            )
        ))

    def chosen(blocks: Column) -> Column:
        none = F.struct(
            F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("start"), F.lit(None).cast("bigint").alias("best"),
            F.lit(0).alias("first"), F.lit(-1).alias("last"),
        )
        run = let(F.aggregate(blocks, none, step), lambda s: F.slice(blocks, s["first"] + 1, s["last"] - s["first"] + 1))
        return let(run, lambda r: F.struct(
            F.array_join(F.transform(r, lambda b: b["text"]), "\n").alias("text"),
            F.array_join(F.transform(r, lambda b: b["markup"]), "").alias("markup"),
        ))

    pieces = F.split(decluttered, rf"(?i)(?=</?(?:{_BLOCK})[\s/>])")
    told = F.filter(F.transform(pieces, described), lambda b: b["text"] != "")
    numbered = F.transform(told, lambda b, i: F.struct(b["text"].alias("text"), b["weight"].alias("weight"), b["markup"].alias("markup"), i.alias("n")))
    return let(numbered, chosen)


def main_text(decluttered: Column, minimum: int = K.MIN_EXTRACT_CHARS) -> Column:
    """First of region, paragraphs of the densest run and the whole page which is long enough."""
    def long_enough(text: Column) -> Column:
        return let(text, lambda t: F.when(F.length(t) > minimum, t))

    return F.coalesce(
        long_enough(region_text(decluttered)),
        long_enough(paragraph_text(densest_run(decluttered)["markup"])),
        text_lines(decluttered),
    )


def is_html(status_code: Column, content_type: Column) -> Column:
    """Content type says HTML or nothing, and the status is no error."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    wanted = (kind == "") | kind.contains("text/html") | kind.contains("application/xhtml+xml")
    return wanted & F.coalesce(status_code < 400, F.lit(False))


def is_js_shell(html: Column, visible: Column, limit: int = K.SHELL_CHARS) -> Column:
    """Empty, or marked as rendered in the browser with little visible text."""
    marked = html.rlike("(?i)" + "|".join(K.SHELL_MARKERS))
    return F.coalesce(html == "", F.lit(True)) | (marked & (F.length(visible) < limit))
