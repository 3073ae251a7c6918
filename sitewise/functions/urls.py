"""URL columns: normal form, domain, resolution, row ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions.text import let, strip


def normalize_url(url: Column) -> Column:
    """Strip, add https if no http(s) scheme, drop the fragment, path at least '/'.

    Every step reads its input once, so the chain stays in generated code.
    """
    out = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), r"[\t\r\n]", "")
    out = F.regexp_replace(out, r"(?s)^(?!(?i:https?)://)(?=.)", "https://")
    out = F.regexp_replace(out, r"(?s)#.*", "")
    out = F.regexp_replace(out, r"\?\z", "")
    out = F.regexp_replace(out, r"(?s)^((?i:https?)://[^/?]*+)(?=\?|\z)", "$1/")
    out = F.regexp_replace(out, r"(?s)^([^?]*/[^;/?]*+);(?=\?|\z)", "$1")
    out = F.regexp_replace(out, r"^(?i:http)(?=://)", "http")
    return F.regexp_replace(out, r"^(?i:https)(?=://)", "https")


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def host_of(location: Column) -> Column:
    """Network location without user, port and trailing dots."""
    return F.regexp_replace(location, r"^.*@|:\d*\z|\.+(?=:\d*\z|\z)", "")


def _tails(host: Column) -> Column:
    """``a.b.c`` to ``[a.b.c, b.c, c]``."""
    return let(F.split(host, r"\."), lambda labels: F.transform(
        labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    ))


def parent(tail: Column) -> Column:
    return F.regexp_extract(tail, r"^[^.]*\.(.*)$", 1)


@cache
def _suffix_test(suffixes: tuple[str, ...]) -> str:
    """A SQL lambda which tells whether a tail is a public suffix."""
    if len(suffixes) > K.MAX_INLINE_SUFFIXES:
        raise ValueError(f"{len(suffixes)} suffix rules; join them as a table instead")
    rules = [s.lower().replace("\\", "").replace("'", "") for s in suffixes]

    def among(value: str, names: list[str]) -> str:
        return f"{value} in (" + ", ".join(f"'{n}'" for n in names) + ")"

    test = among("t", [r for r in rules if r[0] not in "*!"] or [""])
    if wild := [r[2:] for r in rules if r.startswith("*.")]:
        test = f"({test} or " + among("regexp_extract(t, '^[^.]*[.](.*)$', 1)", wild) + ")"
    if exempt := [r[1:] for r in rules if r.startswith("!")]:
        test = f"{test} and not " + among("t", exempt)
    return f"t -> {test}"


def domain_of(location: Column, suffixes: Sequence[str] = K.DEFAULT_SUFFIXES) -> Column:
    """Registrable domain of a network location, else the location itself.

    The rules become one hash set inside the plan: no join, no shuffle.  Plain,
    wildcard (``*.x``) and exception (``!x``) rules are understood.  For rule
    lists too long to inline use :func:`sitewise.operators.domains.with_domain`.
    """
    test = _suffix_test(tuple(suffixes))

    def registrable(tails: Column) -> Column:
        # Longest suffix first; the tail before it is the domain.
        flags = F.call_function("transform", tails, F.expr(test))
        return let(
            F.array_position(flags, True).cast("int"),
            lambda at: F.when(at > 1, F.get(tails, at - 2)),
        )

    return F.coalesce(let(_tails(host_of(location)), registrable), location)


def domain_key(url: Column, suffixes: Sequence[str] = K.DEFAULT_SUFFIXES) -> Column:
    return domain_of(netloc(url), suffixes)


def url_parts(url: Column) -> Column:
    """Scheme, origin and path of a normalised base URL, for :func:`resolve`."""
    return F.struct(
        F.regexp_extract(url, r"^([^:/?#]+):", 1).alias("scheme"),
        F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0).alias("origin"),
        F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"^[^#]*", 0).alias("whole"),
    )


def _without_dots(path: Column) -> Column:
    """Remove '.' and '..' segments."""
    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(part == ".", done)
            .otherwise(F.concat(done, F.array(part)))
        )

    def folded(value: Column) -> Column:
        kept = F.aggregate(
            F.split(value, "/"), F.array().cast("array<string>"), step,
            lambda done: F.array_join(done, "/"),
        )
        closing = F.when(value.rlike(r"(?:^|/)\.{1,2}\z"), F.lit("/")).otherwise(F.lit(""))
        return F.regexp_replace(F.concat(F.lit("/"), kept, closing), r"^/+|/+\z", "/")

    return let(path, lambda value: F.when(
        value.rlike(r"(?:^|/)\.{1,2}(?:/|\z)"), folded(value)
    ).otherwise(value))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of an href against the parts of its base URL (RFC 3986)."""
    def placed(ref: Column) -> Column:
        path = F.regexp_extract(ref, r"^[^?]*", 0)
        query = F.regexp_extract(ref, r"(?s)\?.*", 0)
        folder = F.regexp_replace(base.path, r"[^/]*\z", "")
        relative = F.regexp_replace(F.concat(folder, F.lit("/"), path), r"/{2,}", "/")
        return (
            F.when(ref == "", base.whole)
            .when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(base.scheme, F.lit(":"), ref))
            .when(ref.startswith("?"), F.concat(base.origin, base.path, ref))
            .when(ref.startswith("/"), F.concat(base.origin, _without_dots(path), query))
            .otherwise(F.concat(base.origin, _without_dots(relative), query))
        )

    return let(F.regexp_replace(strip(href), r"(?s)[\t\r\n]|#.*", ""), placed)


def stable_row_id(value: Column, ordinal: Column) -> Column:
    """``site_`` and 12 hex digits of SHA-1, or ``row_<ordinal>`` if empty."""
    key = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(key == "", F.concat(F.lit("row_"), ordinal.cast("string"))).otherwise(
        F.concat(F.lit("site_"), F.substring(F.sha1(key), 1, 12))
    )
