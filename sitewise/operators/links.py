"""Link tables and crawl plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions import html as H
from sitewise.functions import links as L
from sitewise.functions import urls as U
from sitewise.functions.text import let, on
from sitewise.operators.bloom import may_match
from sitewise.operators.stages import settled


def page_links(fetches: DataFrame) -> DataFrame:
    """One row per anchor with an href: ``pos`` and ``href``, html dropped."""
    found = fetches.withColumn("_hrefs", H.hrefs(H.reduce_html(F.col("html")))).drop("html")
    kept = [c for c in found.columns if c != "_hrefs"]
    # The outer form: the plain one adds a filter on the array, which works it out twice.
    rows = found.select(*kept, F.posexplode_outer("_hrefs").alias("pos", "href"))
    return rows.where(F.col("pos").isNotNull())


def scored_links(
    homes: DataFrame, suffixes: Sequence[str] = K.DEFAULT_SUFFIXES, keep_html: bool = False
) -> DataFrame:
    """Pages (``final_url``, ``html``) with ``_home`` and their ``_ranked`` links."""
    own = tuple(suffixes) == K.DEFAULT_SUFFIXES
    domain = on(U.domain_key, "final_url") if own else U.domain_key(F.col("final_url"), suffixes)
    links = (
        on(L.internal_links, "_base", "_domain", "_hrefs") if own
        else L.internal_links(F.col("_base"), F.col("_domain"), F.col("_hrefs"), suffixes)
    )
    return (
        homes.withColumn("_hrefs", on(followable, "html"))
        .withColumns({
            "_base": on(U.url_parts, "final_url"),
            "_domain": domain,
            "_home": on(U.normalize_url, "final_url"),
        })
        .drop(*(() if keep_html else ("html",)))
        .withColumns({"_links": links, "_common": on(L.common_urls, "_base")})
        .withColumn("_ranked", on(ranked_links, "_links", "_common"))
        .drop("_hrefs", "_base", "_domain", "_links", "_common")
    )


def followable(html: Column) -> Column:
    """The hrefs of a page which may be followed."""
    return F.filter(H.hrefs(H.reduce_html(html)), H.is_followable)


def ranked_links(links: Column, common: Column) -> Column:
    return L.ranked(L.score_links(links, common))


def _as_rows(planned: DataFrame, plan: str) -> DataFrame:
    """Explode a plan array, which always has the home page, into rows."""
    kept = [c for c in planned.columns if not c.startswith("_")]
    return planned.select(*kept, F.posexplode_outer(plan).alias("pos", "_link")).select(
        *kept, "pos", F.col("_link.url").alias("url"), F.col("_link.score").alias("score")
    )


def link_candidates(
    homes: DataFrame,
    max_links: int = K.MAX_LINKS,
    suffixes: Sequence[str] = K.DEFAULT_SUFFIXES,
) -> DataFrame:
    """Home first, then its best links and common paths, ``max_links`` in all.

    The home page has a null score.  No exchange: each page plans on its own.
    """
    return plan_rows(scored_links(homes, suffixes), max_links)


def plan_rows(scored: DataFrame, max_links: int) -> DataFrame:
    """Plan rows from :func:`scored_links` alone."""
    planned = scored.withColumn(
        "_plan", L.home_first(F.col("_home"), F.col("_ranked"), max_links)
    )
    return _as_rows(planned, "_plan")


def sitemap_urls(
    sitemaps: DataFrame, suffixes: Sequence[str] = K.DEFAULT_SUFFIXES
) -> DataFrame:
    """Same-domain locations of each site's first sitemap which has any.

    ``sitemaps`` holds ``row_id, base_url, path, status_code, xml``.  Result:
    ``row_id, base_url, path`` and the array ``urls`` in file order.
    """
    domain = U.domain_key(F.col("base_url"), suffixes)
    found = settled(
        sitemaps.where((F.col("status_code") < 400) & F.col("path").isin(*K.SITEMAP_PATHS))
        .withColumn("_domain", domain)
        .withColumn("_all", L.sitemap_locations(F.coalesce(F.col("xml"), F.lit(""))))
        .drop("xml")
        .withColumn("urls", L.on_domain(F.col("_all"), F.col("_domain"), suffixes)),
        "urls",
    ).where(F.size("urls") > 0)
    rank = F.array_position(F.array(*map(F.lit, K.SITEMAP_PATHS)), F.col("path"))
    best = W.partitionBy("row_id").orderBy("_rank", "base_url")
    return (
        found.withColumn("_rank", rank)
        .select("row_id", "base_url", "path", "urls", "_rank")
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") == 1)
        .drop("_n", "_rank")
    )


def sitemap_hints(
    sitemaps: DataFrame,
    limit: int = K.MAX_HINTS,
    suffixes: Sequence[str] = K.DEFAULT_SUFFIXES,
) -> DataFrame:
    """``row_id`` and its best sitemap URLs as structs (score, pos, url)."""
    chosen = sitemap_urls(sitemaps, suffixes)
    return chosen.select("row_id", L.ranked_hints(F.col("urls"), limit).alias("hints"))


def plan_with_sitemap(
    homes: DataFrame,
    sitemaps: DataFrame,
    max_pages: int = K.MAX_PAGES,
    max_hints: int = K.MAX_HINTS,
    mode: str = "ranked",
    suffixes: Sequence[str] = K.DEFAULT_SUFFIXES,
) -> DataFrame:
    """Crawl plan of each site from its links and its sitemap hints.

    ``ranked`` orders links and hints together by score, links first among equals.
    ``leftover`` gives hints only the places which links and common paths leave.
    """
    hints = sitemap_hints(sitemaps, max_hints, suffixes)
    return merge_hints(scored_links(homes, suffixes), hints, max_pages, mode)


def merge_hints(
    scored: DataFrame, hints: DataFrame, max_pages: int = K.MAX_PAGES, mode: str = "ranked"
) -> DataFrame:
    """Plan rows from :func:`scored_links` and :func:`sitemap_hints`."""
    if mode not in ("ranked", "leftover"):
        raise ValueError(f"unknown mode {mode!r}")
    both = scored.join(hints, "row_id", "left").withColumn(
        "_hints", F.coalesce(F.col("hints"), F.array().cast("array<struct<score:int,pos:int,url:string>>"))
    ).drop("hints")
    links_only = L.home_first(F.col("_home"), F.col("_ranked"), max_pages)
    if mode == "leftover":
        places = F.greatest(F.lit(max_pages) - F.size("_links"), F.lit(0))
        both = both.withColumn("_links", links_only).withColumn("_plan", F.concat(
            F.col("_links"),
            L.not_in(F.slice(F.col("_hints"), F.lit(1), places), F.col("_links")),
        ))
    else:
        placed = let(F.size("_ranked"), lambda n: F.transform(
            L.not_in(F.col("_hints"), F.col("_ranked")),
            lambda h: F.struct(
                h.score.alias("score"), (h.pos + n).alias("pos"), h.url.alias("url")
            ),
        ))
        both = both.withColumn("_all", L.ranked(F.concat(F.col("_ranked"), placed)))
        both = both.withColumn("_plan", L.home_first(F.col("_home"), F.col("_all"), max_pages))
    return _as_rows(both.drop("_links", "_all", "_ranked"), "_plan")


def unvisited(plan: DataFrame, visited: DataFrame) -> DataFrame:
    """Planned URLs of a site which it has not visited."""
    return plan.join(visited.select("row_id", "url"), ["row_id", "url"], "left_anti")


def latest_by_url(archive: DataFrame, order: str = "fetched_at") -> DataFrame:
    """The newest copy of every URL; copies are cut ahead of the exchange."""
    newest = W.partitionBy("url").orderBy(F.col(order).desc(), F.col("page_id"))
    return (
        archive.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")
    )


#: What names a copy of a page in an archive.
COPY = ["url", "fetched_at", "page_id"]


def newest_copies(archive: DataFrame, urls: DataFrame) -> DataFrame:
    """The newest copy's ``url, fetched_at, page_id`` of the URLs asked for, and of a few others.

    Narrow columns only; copies of other URLs go in the scan stage. ``urls`` should be stored.
    """
    return latest_by_url(may_match(archive.select(*COPY), urls, ["url"]))


def copies(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """Archive rows which may be among the copies wanted; nearly all others go in the scan stage.

    ``wanted`` should be stored; an exact join on ``COPY`` is to follow.
    """
    return may_match(archive, wanted, COPY)


def join_copies(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The exact join on ``COPY``; nulls are equal."""
    renamed = found.withColumnsRenamed({c: f"_k_{c}" for c in COPY})
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in COPY]
    return wanted.join(renamed, on).drop(*(f"_k_{c}" for c in COPY))


def to_fetch(plan: DataFrame) -> DataFrame:
    """Planned pages which the archive does not have, in the order in which a site wants them."""
    return plan.where(~F.col("hit")).select("row_id", "url", "pos")


def crawl_lookup(plan: DataFrame, archive: DataFrame) -> DataFrame:
    """Answer a crawl plan from an archive of pages; ``hit`` is false on a miss.

    ``archive`` has one row per normalised ``url`` (see :func:`latest_by_url`).  Both
    sides may be large: an equi-join, with AQE to split skewed partitions.
    """
    marked = archive.withColumn("hit", F.lit(True))
    return plan.join(marked, "url", "left").withColumn(
        "hit", F.coalesce(F.col("hit"), F.lit(False))
    )
