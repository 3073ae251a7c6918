"""Link and sitemap columns: scoring and per-page planning.

A page's links are bounded by the page itself, so they are resolved, de-duplicated
and ranked inside its row.  No link ever enters a shuffle before the cut.

What a lambda uses from outside is bound by ``let`` first.  A plain column would do
the same, but the optimiser may put its definition into the lambda, to be
worked out again for every element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions.text import let
from sitewise.functions.urls import domain_key, normalize_url, resolve


def slashes(url: Column) -> Column:
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def keyword_hits(url: Column) -> Column:
    """How many keywords occur anywhere in the lower-case URL."""
    found = " + ".join(f"int(contains(u, '{k}'))" for k in K.KEYWORDS)
    return F.get(F.call_function("transform", F.array(F.lower(url)), F.expr(f"u -> {found}")), F.lit(0))


def link_score(url: Column) -> Column:
    return keyword_hits(url) * 2 + F.greatest(F.lit(3) - slashes(url), F.lit(0))


def hint_score(url: Column) -> Column:
    return keyword_hits(url) * 3 + F.greatest(F.lit(4) - slashes(url), F.lit(0))


def internal_links(
    base: Column, domain: Column, hrefs: Column, suffixes: Sequence[str] = K.DEFAULT_SUFFIXES
) -> Column:
    """Normal form of the hrefs which stay on the domain; first seen, in order."""
    urls = let(base, lambda b: F.transform(hrefs, lambda h: normalize_url(resolve(b, h))))
    return on_domain(F.array_distinct(urls), domain, suffixes)


def on_domain(urls: Column, domain: Column, suffixes: Sequence[str] = K.DEFAULT_SUFFIXES) -> Column:
    return let(domain, lambda d: F.filter(
        urls, lambda u: (u != "") & (domain_key(u, suffixes) == d)
    ))


def common_urls(base: Column) -> Column:
    return let(base, lambda b: F.transform(
        F.array(*map(F.lit, K.COMMON_PATHS)), lambda p: normalize_url(resolve(b, p))
    ))


def ranked(scored: Column) -> Column:
    """Order structs (score, pos, url) by falling score; ties keep their order."""
    keyed = F.transform(scored, lambda s: F.struct(
        (-s.score).alias("down"), s.pos.alias("pos"), s.url.alias("url"), s.score.alias("score")
    ))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(
        s.score.alias("score"), s.pos.alias("pos"), s.url.alias("url")
    ))


def score_links(links: Column, common: Column) -> Column:
    """Scored page links, then the common paths not seen among them."""
    return let(links, lambda own: F.transform(F.array_union(own, common), lambda u, i: F.struct(
        F.when(i < F.size(own), link_score(u)).otherwise(K.COMMON_PATH_SCORE).alias("score"),
        i.alias("pos"),
        u.alias("url"),
    )))


def home_first(home: Column, best: Column, limit: int) -> Column:
    """The home page and the best of the others, ``limit`` in all."""
    def placed(h: Column) -> Column:
        first = F.array(F.struct(
            F.lit(None).cast("int").alias("score"), F.lit(-1).alias("pos"), h.alias("url")
        ))
        others = F.filter(best, lambda s: s.url != h)
        return F.concat(first, F.slice(others, 1, limit - 1))

    return let(home, placed)


def not_in(found: Column, known: Column) -> Column:
    """Structs whose URL is not among those of ``known``."""
    return let(F.transform(known, lambda s: s.url), lambda urls: F.filter(
        found, lambda s: ~F.array_contains(urls, s.url)
    ))


def sitemap_locations(xml: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)),
        normalize_url,
    )


def ranked_hints(urls: Column, limit: int) -> Column:
    """Distinct sitemap URLs by falling score, cut to ``limit``."""
    scored = F.transform(F.array_distinct(urls), lambda u, i: F.struct(
        hint_score(u).alias("score"), i.alias("pos"), u.alias("url")
    ))
    return F.slice(ranked(scored), 1, limit)
