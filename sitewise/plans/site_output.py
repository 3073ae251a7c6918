"""The whole job: sites and fetches to the enriched site table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise import schema as S
from sitewise.functions.urls import normalize_url
from sitewise.operators import fetches as merging
from sitewise.operators import links, pages, resume, sites
from sitewise.sources.scratch import stored


def page_records(
    fetches: DataFrame,
    max_pages: int = K.MAX_PAGES,
    time_budget_sec: float = K.TIME_BUDGET_SEC,
    page_delay_sec: float = K.PAGE_DELAY_SEC,
    min_page_chars: int = K.MIN_PAGE_CHARS,
) -> DataFrame:
    """Fetches, or their content, to checked page records within each site's limits.

    Text is taken out in the scan stage.  One exchange on ``row_id`` then serves the
    page limit, the time limit and the roll-up which follows.
    """
    content = pages.page_content(fetches) if "html" in fetches.columns else fetches
    capped = pages.cap_pages(content, max_pages)
    return checked(pages.within_budget(capped, time_budget_sec, page_delay_sec), min_page_chars)


def merged_page_records(
    fetches: DataFrame,
    max_pages: int = K.MAX_PAGES,
    time_budget_sec: float = K.TIME_BUDGET_SEC,
    page_delay_sec: float = K.PAGE_DELAY_SEC,
    min_page_chars: int = K.MIN_PAGE_CHARS,
    done: DataFrame | None = None,
) -> DataFrame:
    """Checked page records, each page once however often it was fetched.

    Merging, page limit, time limit and the ids in ``done``, whose sites are left out, are settled on
    narrow columns first. Then text is taken out only of the fetches which stand and are within the
    limits, in the scan stage; no HTML is in an exchange.
    """
    merged = merging.merged_records(merging.identified(fetches))
    if done is not None:
        merged = merged.join(done, "row_id", "left_anti")
    capped = pages.cap_pages(merged, max_pages)
    records = stored(pages.within_budget(capped, time_budget_sec, page_delay_sec), "page-records")
    wide = merging.standing(fetches, records)
    content = pages.page_content(wide) if "html" in fetches.columns else wide
    return checked(merging.with_records(content, records), min_page_chars)


def checked(kept: DataFrame, min_page_chars: int = K.MIN_PAGE_CHARS) -> DataFrame:
    """Page records of the pages kept; the home page goes by the URL where it landed."""
    landed = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    return pages.page_results(
        kept.withColumn("url", F.when(F.col("is_home"), landed).otherwise(F.col("url"))),
        min_page_chars,
    )


def site_results(
    fetches: DataFrame,
    max_chars_full: int = K.MAX_CHARS_FULL,
    preview_chars: int = K.PREVIEW_CHARS,
    max_pages: int = K.MAX_PAGES,
    merge: bool = False,
    done: DataFrame | None = None,
    **limits: float,
) -> DataFrame:
    """One result row per fetched site, but for the ids in ``done``.

    ``merge`` takes several fetches of a page as one.
    """
    if merge:
        records = merged_page_records(fetches, max_pages, done=done, **limits)
    else:
        left = fetches if done is None else fetches.join(done, "row_id", "left_anti")
        records = page_records(left, max_pages, **limits)
    return sites.roll_up(records, max_pages, max_chars_full, preview_chars)


def site_output(
    sheet: DataFrame, fetches: DataFrame, earlier: DataFrame | None = None, merge: bool | None = None,
    **limits: float,
) -> DataFrame:
    """Every input row with its result columns.

    Rows without a URL are skipped; rows without a fetch keep their earlier result
    and stay pending if they have none. Finished sites keep their result, and none of their pages is
    extracted again. Several fetches of a page count as one, unless ``merge`` is off; content which is
    extracted already (no ``html``) is taken to be merged.
    """
    keyed = sites.key_sites(sheet)
    merged = resume.resume_merge(keyed.drop("normalized_url"), earlier)
    merged = merged.withColumn("normalized_url", normalize_url(F.col("website")))
    done = None
    if earlier is not None:
        done = merged.where(~resume.is_pending(F.col("scrape_status"))).select("row_id").distinct()
    if merge is None:
        merge = "html" in fetches.columns
    written = resume.upsert_results(merged, site_results(fetches, merge=merge, done=done, **limits))
    empty = F.col("normalized_url") == ""
    extra = [c for c in sheet.columns if c not in S.SITE_OUTPUT.names]
    counts = ("pages_attempted", "pages_scraped", "total_bytes", "total_text_len", "main_text_len", "pages_planned")
    return written.withColumns({
        **{c: F.when(empty, F.lit(0).cast(S.SITE_OUTPUT[c].dataType)).otherwise(F.col(c)) for c in counts},
        **{c: F.when(empty, F.lit(False)).otherwise(F.col(c)) for c in ("truncated_full", "truncated_preview")},
        "scrape_status": F.when(empty, "skipped").otherwise(F.col("scrape_status")),
        "error_reason": F.when(empty, "empty_url").otherwise(F.col("error_reason")),
    }).select(*extra, *S.SITE_OUTPUT.names)


def archive_plan(
    sheet: DataFrame,
    archive: DataFrame,
    max_pages: int = K.MAX_PAGES,
    sitemaps: DataFrame | None = None,
    suffixes: Sequence[str] = K.DEFAULT_SUFFIXES,
) -> DataFrame:
    """Crawl plan of every site from its archived home page, looked up in the archive.

    ``archive`` holds fetches keyed by normalised ``url`` with a ``page_id``; the newest copy of a URL
    counts. Result: ``row_id, pos, url, hit`` and the found copy's ``fetched_at`` and ``page_id``. A site
    whose home page is not archived has its home page alone. The result is stored.

    The archive is searched on (url, fetched_at, page_id) alone, and only for URLs which are asked for;
    links are taken out of the home pages and no others.
    """
    wanted = sites.key_sites(sheet).where(F.col("normalized_url") != "").groupBy("row_id").agg(
        F.min_by("normalized_url", "ord").alias("url")
    )
    first = stored(links.crawl_lookup(wanted, links.newest_copies(archive, stored(wanted.select("url"), "home-urls"))), "homes")
    found = first.where("hit").select("row_id", *links.COPY)
    landed = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    homes = pages.usable_html(links.copies(archive.drop("row_id", "pos"), found)).withColumn("final_url", landed)
    linked = links.scored_links(homes, suffixes).select(*links.COPY, "_home", "_ranked").dropDuplicates(links.COPY)
    ranked = links.join_copies(found, linked).select("row_id", "_home", "_ranked")
    if sitemaps is None:
        inner = links.plan_rows(ranked, max_pages)
    else:
        inner = links.merge_hints(ranked, links.sitemap_hints(sitemaps, suffixes=suffixes), max_pages)
    inner = stored(inner.where(F.col("pos") > 0).select("row_id", "url", F.col("pos").cast("bigint")), "plan")
    looked_up = links.crawl_lookup(inner, links.newest_copies(archive, inner.select("url")))
    return stored(first.withColumn("pos", F.lit(0).cast("bigint")).unionByName(looked_up), "plan-hits")


def planned_content(plan: DataFrame, archive: DataFrame) -> DataFrame:
    """Page content of the copies which an :func:`archive_plan` found, with ``row_id`` and ``pos``.

    Text is taken out of these copies and (but for a few in a hundred) no others, in the scan stage.
    """
    hits = plan.where("hit").select("row_id", "pos", *links.COPY)
    content = pages.page_content(links.copies(archive.drop("row_id", "pos"), hits)).dropDuplicates(links.COPY)
    return links.join_copies(hits, content)


def crawl_from_archive(
    sheet: DataFrame,
    archive: DataFrame,
    max_pages: int = K.MAX_PAGES,
    sitemaps: DataFrame | None = None,
    suffixes: Sequence[str] = K.DEFAULT_SUFFIXES,
) -> DataFrame:
    """Plan every site from its archived home page and answer the plan, ready for :func:`site_output`.

    Pages which are planned and not archived are in :func:`archive_plan`, see
    :func:`sitewise.operators.links.to_fetch`.
    """
    return planned_content(archive_plan(sheet, archive, max_pages, sitemaps, suffixes), archive)
