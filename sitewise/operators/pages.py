"""From fetches to page records.

``page_content`` is one narrow stage; everything after it carries text but no
HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions import html as H
from sitewise.functions.text import on, to_millis, utf8_bytes
from sitewise.operators.stages import settled


def usable_html(fetches: DataFrame) -> DataFrame:
    """Null the body of errors and of what is not HTML; empty counts as null.

    A page which a browser rendered stands whatever the status: a blocked plain fetch is why
    it was rendered.
    """
    fit = _rendered(fetches) | H.is_html(F.col("status_code"), F.col("content_type"))
    return fetches.withColumn("html", F.when(fit, F.nullif(F.col("html"), F.lit(""))))


def _rendered(fetches: DataFrame) -> Column:
    if "method" not in fetches.columns:
        return F.lit(False)
    return F.coalesce(F.col("method") == K.BROWSER_METHOD, F.lit(False))


def page_content(
    fetches: DataFrame, extract_chars: int = K.MIN_EXTRACT_CHARS, metadata: bool = True
) -> DataFrame:
    """Replace ``html`` by its text, sizes and metadata.

    The reduced and the decluttered page get a projection each, so that no
    pattern runs twice on a page.
    """
    out = usable_html(fetches).withColumns({
        "_reduced": on(H.reduce_html, "html"),
        "has_html": F.col("html").isNotNull(),
        "bytes": utf8_bytes(F.col("html")),
    }).drop("html")
    found = {"_decluttered": on(H.declutter, "_reduced")}
    shown = {"main_text": H.main_text(F.col("_decluttered"), extract_chars)}
    if extract_chars == K.MIN_EXTRACT_CHARS:
        shown["main_text"] = on(H.main_text, "_decluttered")
    if metadata:
        first = F.get(F.col("_headings"), F.lit(0))
        found |= {
            "_headings": on(H.headings, "_reduced"),
            "_title": on(H.title, "_reduced"),
            "meta_description": on(H.meta_description, "_reduced"),
        }
        shown |= {
            "title": F.coalesce(F.nullif(F.col("_title"), F.lit("")), first, F.lit("")),
            "headings": F.to_json("_headings"),
        }
    out = out.withColumns(found).withColumns(shown).withColumn("text_len", F.length("main_text"))
    return out.drop("_reduced", "_decluttered", "_headings", "_title")


def cap_pages(pages: DataFrame, max_pages: int = K.MAX_PAGES) -> DataFrame:
    """The first pages of each site; ``pos`` becomes 0, 1, .. and 0 is home.

    Spark turns the filter on the row number into a group limit which runs ahead
    of the exchange, so that a site with very many pages sends only a few rows
    per task.
    """
    order = W.partitionBy("row_id").orderBy("pos")
    return (
        pages.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= max_pages)
        .withColumn("pos", F.col("_n") - 1)
        .withColumn("is_home", F.col("_n") == 1)
        .drop("_n")
    )


def first_pages(pages: DataFrame, max_pages: int = K.MAX_PAGES) -> DataFrame:
    """The first pages of each site, their columns untouched.

    What this drops of a part of a site's pages can never be among the first pages
    of the whole site.
    """
    order = W.partitionBy("row_id").orderBy("pos")
    ranked = pages.withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= max_pages).drop("_n")


def within_budget(
    pages: DataFrame,
    budget_sec: float = K.TIME_BUDGET_SEC,
    page_delay_sec: float = K.PAGE_DELAY_SEC,
) -> DataFrame:
    """Capped pages for which the time spent before them is within the budget.

    For the output of :func:`cap_pages`, where a site has few rows.  The same
    partitioning serves both, so this adds no exchange.
    """
    if not budget_sec:
        return pages
    spent = to_millis(F.col("elapsed_sec")) + F.when(F.col("is_home"), 0).otherwise(
        round(page_delay_sec * 1000)
    )
    before = W.partitionBy("row_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return (
        pages.withColumn("_spent", F.coalesce(F.sum(spent).over(before), F.lit(0)))
        .where(F.col("_spent") <= round(budget_sec * 1000))
        .drop("_spent")
    )


def page_results(pages: DataFrame, min_page_chars: int = K.MIN_PAGE_CHARS) -> DataFrame:
    """Add ``ok`` and settle ``error`` of each page; needs ``is_home``."""
    ok = F.when(F.col("is_home"), F.col("text_len") > 0).otherwise(
        F.col("text_len") > min_page_chars
    )
    given = F.nullif(F.col("error"), F.lit(""))
    status = F.when(
        ~F.col("has_html"), F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))
    )
    short = F.when(F.col("is_home"), F.lit("empty_text")).otherwise(F.lit("empty_or_too_short"))
    return pages.withColumn("ok", ok).withColumn(
        "error", F.coalesce(given, status, F.when(~F.col("ok"), short), F.lit(""))
    )


def render_reason(
    html: Column, visible: Column, text_len: Column, min_text: int = K.MIN_TEXT
) -> Column:
    """Why a page should be fetched again with a browser; null if it need not."""
    return (
        F.when(F.coalesce(html, F.lit("")) == "", "no_html")
        .when(H.is_js_shell(html, visible), "js_shell")
        .when(text_len < min_text, "short_text")
    )


def render_queue(fetches: DataFrame, min_text: int = K.MIN_TEXT) -> DataFrame:
    """Fetches which need a browser, each with its reason; those by a browser had their turn."""
    staged = usable_html(fetches.where(~_rendered(fetches))).withColumn("_reduced", on(H.reduce_html, "html")).withColumns({
        "_visible": on(H.full_text, "_reduced"),
        "_decluttered": on(H.declutter, "_reduced"),
    }).withColumn("text_len", F.length(on(H.main_text, "_decluttered"))).withColumn(
        "reason",
        render_reason(F.col("html"), F.col("_visible"), F.col("text_len"), min_text),
    )
    queue = settled(staged.drop("html", "_reduced", "_visible", "_decluttered"), "reason")
    return queue.where(F.col("reason").isNotNull())
