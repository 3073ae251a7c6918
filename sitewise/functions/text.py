"""Text columns: whitespace, entities, lengths, limits, times."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode.  Patterns use (?U)\s: one test by character type is far faster
# than a class made up of ranges.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# The references met on nearly every page.
_USUAL_ENTITIES = (
    ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\xa0"), ("#39", "'"),
    ("copy", "\xa9"), ("middot", "\xb7"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def on(function: Callable[..., Column], *names: str) -> Column:
    """``function`` over columns given by name, built once per process.

    Building one of the longer functions takes hundreds of calls from the client to
    the JVM; a column is immutable and serves any number of plans.
    """
    return function(*map(F.col, names))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """All white space runs to one blank, ends stripped.

    Single blanks, by far the most of them, do not match and are not rewritten.
    """
    return strip(F.regexp_replace(text, r"(?U)\s(?:(?<! )|(?=\s))\s*+", " "))


def clean_text(text: Column) -> Column:
    """Blank-like runs to a blank, three or more line ends to two, strip.

    Looking for a substring is far cheaper than a pattern over the whole text, so
    each pattern runs only on texts which need it.
    """
    def fixed(value: Column, signs: str, pattern: str, by: str) -> Column:
        return let(value, lambda v: F.when(
            reduce(or_, [F.contains(v, F.lit(s)) for s in signs.split("|")]),
            F.regexp_replace(v, pattern, by),
        ).otherwise(v))

    out = fixed(F.coalesce(text, F.lit("")), "\u00a0|\t|\r", r"[\u00A0\t\r]+", " ")
    out = fixed(out, "\n\n\n", r"\n{3,}", "\n\n")
    return strip(fixed(out, "  ", " {2,}", " "))


def _quoted(char: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in char) + "'"


@cache
def _decoder() -> str:
    """A SQL lambda which decodes the character references of a text.

    In SQL because it is used in many places: one call builds it.
    """
    def bind(value: str, name: str, body: str) -> str:
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    usual = "t"
    for name, char in _USUAL_ENTITIES:
        usual = f"replace({usual}, '&{name};', {_quoted(char)})"
    names = {"apos": 39} | name2codepoint
    pairs = ", ".join(f"'{n}', {_quoted(chr(c))}" for n, c in names.items())
    number = (
        "try_cast(if(lower(substring(ref, 2, 1)) = 'x', conv(substring(ref, 3), 16, 10), "
        "substring(ref, 2)) as int)"
    )
    by_number = bind(number, "code", (
        "if(code between 1 and 55295 or code between 57344 and 1114111, "
        "decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32'), null)"
    ))
    char = (
        f"case when ref = '' then null when startswith(ref, '#') then {by_number} "
        f"else try_element_at(map({pairs}), ref) end"
    )
    shape = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});"
    piece = bind(f"regexp_extract(piece, '{shape}', 1)", "ref", bind(
        char, "char",
        "if(char is null, concat('&', piece), concat(char, substring(piece, length(ref) + 2)))",
    ))
    each = bind("split(v, '&')", "parts", (
        f"concat(parts[0], array_join(transform(slice(parts, 2, size(parts)), piece -> {piece}), ''))"
    ))
    rest = f"if(v rlike '&(?!amp;)[#a-zA-Z][a-zA-Z0-9]*;', {each}, replace(v, '&amp;', '&'))"
    return f"t -> if(contains(t, '&'), {bind(usual, 'v', rest)}, t)"


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references, each once.

    ``&amp;lt;`` gives ``&lt;``, and a reference needs its semicolon.  The usual few
    are replaced first; only texts which hold others are cut up at ``&``.
    """
    return F.get(F.call_function("transform", F.array(text), F.expr(_decoder())), F.lit(0))


def truncate(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def over_limit(text: Column, limit: int) -> Column:
    return F.length(text) > limit


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")


def iso_utc(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, three places."""
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0), 3)


def to_millis(seconds: Column) -> Column:
    """Whole milliseconds: sums of these do not depend on their order."""
    return F.round(F.coalesce(seconds, F.lit(0.0)) * 1000).cast("bigint")
