"""From page records to one row per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions.text import let, seconds_between
from sitewise.functions.urls import normalize_url, stable_row_id
from sitewise.operators.prefix import ROWS_PER_PART, prefix_sums

RULE = "-" * 80


def combined(parts: Column) -> Column:
    """Texts of structs (url, text) under their URLs, rules between; '' if none."""
    kept = F.filter(parts, lambda p: F.coalesce(p.text, F.lit("")) != "")
    bodies = F.transform(kept, lambda p: F.concat(F.lit("URL: "), p.url, F.lit("\n"), p.text))
    return let(bodies, lambda b: F.when(
        F.size(b) > 0, F.concat(F.lit("\n\n"), F.array_join(b, f"\n\n{RULE}\n\n"))
    ).otherwise(F.lit("")))


def key_sites(sheet: DataFrame) -> DataFrame:
    """Add ``row_id`` (unless given) and ``normalized_url``; needs ``website``, ``ord``."""
    if "website" not in sheet.columns:
        raise ValueError("the site list needs a 'website' column")
    if "row_id" not in sheet.columns:
        sheet = sheet.withColumn("row_id", stable_row_id(F.col("website"), F.col("ord")))
    return sheet.withColumn("normalized_url", normalize_url(F.col("website")))


def combine_texts(
    pages: DataFrame, key: str, order: str, url: str, text: str,
    max_chars: int = K.MAX_CHARS_FULL,
) -> DataFrame:
    """Ordered combined text per key, cut to ``max_chars``; for groups of any size. Beside it
    ``n_chars``, the length of the whole text, and ``truncated``, whether it is longer than the cut one.

    Every part brings its URL line and rule, so the result is full after a known
    number of parts, and the rest of a group is dropped ahead of the exchange.  Of
    those left, only parts which start within ``max_chars`` are collected.
    """
    overhead = len(RULE) + len("URL: \n") + 4
    most = max_chars // overhead + 2
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    ranked = W.partitionBy(key).orderBy("_empty", order)
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    parts = (
        pages.select(
            key, F.col(order).alias(order), F.col(url).alias("_url"), empty.alias("_empty"),
            F.substring(F.col(text), 1, max_chars).alias("_text"),
        )
        .withColumn("_n", F.row_number().over(ranked))
        .where(F.col("_n") <= most)
        .withColumn("_start", F.coalesce(F.sum(F.length("_text")).over(before), F.lit(0)))
        .where(F.col("_start") <= max_chars)
    )
    listed = F.array_sort(F.collect_list(F.struct(
        F.col("_n").alias("pos"), F.col("_url").alias("url"), F.col("_text").alias("text")
    )))
    # Lengths of whole groups: partial sums, no group in one task. A part without URL is in no text.
    some, body = ~empty, F.length(url) + F.length(text) + len("URL: \n")
    bodies = F.count_if(some & F.col(url).isNotNull())
    whole = F.when(F.count_if(some) == 0, 0).otherwise(
        2 + F.coalesce(F.sum(F.when(some, body)), F.lit(0)) + F.greatest(bodies - 1, F.lit(0)) * (len(RULE) + 4)
    )
    lengths = pages.groupBy(F.col(key).alias("_key")).agg(whole.cast("bigint").alias("n_chars"))
    texts = parts.groupBy(key).agg(listed.alias("_parts"))
    return texts.join(lengths, F.col(key).eqNullSafe(F.col("_key"))).select(
        key, F.substring(combined(F.col("_parts")), 1, max_chars).alias("combined_text"),
        "n_chars", (F.col("n_chars") > max_chars).alias("truncated"),
    )


def combine_chunks(
    pages: DataFrame, key: str, order: list[str], url: str, text: str, chunk_chars: int = 64_000,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """The whole combined text per key, uncut, as rows (key, ``chunk``, ``text``) of ``chunk_chars``
    characters; joined in order they are what :func:`combine_texts` cuts.

    No group meets in one row or task: running sums of the parts' lengths say where each part begins, so
    every part is cut into its chunks by itself, and a chunk gathers only what lies within it. ``order``
    should be unique within a key. Empty texts and parts without a URL are in no chunk; a key without any
    part has none.
    """
    between = len(RULE) + 4
    parts = pages.select(
        key, *order, F.concat(F.lit("URL: "), F.col(url), F.lit("\n"), F.col(text)).alias("_body"), F.col(text).alias("_text")
    ).where(F.col("_body").isNotNull() & (F.col("_text") != "")).drop("_text")
    size = F.length("_body") + between
    placed = prefix_sums(parts, [key], order, {"_end": size}, rows_per_part=rows_per_part).withColumn("_at", F.col("_end") - size)
    # The rule stands ahead of every part but the first, which has two line ends.
    first = F.col("_at") == 0
    placed = placed.select(
        F.col(key), F.when(first, F.concat(F.lit("\n\n"), "_body")).otherwise(F.concat(F.lit(f"\n\n{RULE}\n\n"), "_body")).alias("_part"),
        F.when(first, F.lit(0)).otherwise(F.col("_at") - (between - 2)).cast("bigint").alias("_at"),
    )
    last = F.floor((F.col("_at") + F.length("_part") - 1) / chunk_chars)
    pieces = placed.select(
        key, "_at", "_part", F.explode(F.sequence(F.floor(F.col("_at") / chunk_chars), last)).alias("chunk")
    )
    start = F.greatest(F.col("_at"), F.col("chunk") * chunk_chars)
    stop = F.least(F.col("_at") + F.length("_part"), (F.col("chunk") + 1) * chunk_chars)
    cut = pieces.select(
        key, "chunk", start.alias("_at"), F.substring("_part", (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int")).alias("_piece")
    )
    gathered = F.array_sort(F.collect_list(F.struct("_at", "_piece")))
    return cut.groupBy(key, "chunk").agg(gathered.alias("_pieces")).select(
        key, "chunk", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("text")
    )


def roll_up(
    pages: DataFrame,
    max_pages: int = K.MAX_PAGES,
    max_chars_full: int = K.MAX_CHARS_FULL,
    preview_chars: int = K.PREVIEW_CHARS,
) -> DataFrame:
    """One row per site from its page records (at most ``max_pages`` each).

    Every text is cut to ``max_chars_full`` ahead of the shuffle, so a group holds a
    bounded number of characters.  The limits of the whole row apply afterwards.
    """
    listed = F.array_sort(F.collect_list(F.struct(
        F.col("pos"), F.col("url"), F.col("status_code"),
        F.when(F.col("ok"), F.substring("main_text", 1, max_chars_full)).alias("text"),
    )))
    home = F.max_by(
        F.struct(
            "has_html", "error", "url", "main_text", "title", "meta_description", "headings"
        ),
        F.col("is_home"),
    )
    grouped = pages.groupBy("row_id").agg(
        listed.alias("_pages"),
        home.alias("_home"),
        F.count(F.lit(1)).cast("int").alias("_attempted"),
        F.count_if("ok").cast("int").alias("_scraped"),
        F.sum("bytes").alias("_bytes"),
        F.sum("text_len").cast("bigint").alias("_text_len"),
        F.min("method").alias("_method"),
        F.max("method").alias("_last_method"),
        F.min("fetched_at").alias("started_at"),
        F.max("last_fetched_at" if "last_fetched_at" in pages.columns else "fetched_at").alias("finished_at"),
    ).withColumn("_failed", ~F.col("_home.has_html")).withColumn(
        "_combined", F.when(F.col("_failed"), F.lit("")).otherwise(combined(F.col("_pages")))
    )

    def unless_failed(value: Column, empty: object) -> Column:
        return F.when(F.col("_failed"), F.lit(empty)).otherwise(value)

    statuses = F.filter(F.transform("_pages", lambda p: p.status_code), lambda s: s.isNotNull())
    method = F.coalesce(F.when(
        F.col("_method") == F.col("_last_method"), F.col("_method")
    ).otherwise(F.when(F.col("_method").isNotNull(), F.lit("both"))), F.lit(""))
    reason = F.trim(F.concat(F.lit("homepage_failed: "), F.col("_home.error")))
    return grouped.select(
        "row_id",
        F.when(F.col("_combined") != "", "done").otherwise("error").alias("scrape_status"),
        F.when(F.col("_failed"), reason).when(F.col("_combined") == "", "no_text_extracted")
        .otherwise("").alias("error_reason"),
        F.col("_home.url").alias("final_url"),
        unless_failed(F.col("_attempted"), 0).alias("pages_attempted"),
        unless_failed(F.col("_scraped"), 0).alias("pages_scraped"),
        unless_failed(method, "").alias("methods_used"),
        unless_failed(F.array_join(F.slice(statuses, 1, K.MAX_STATUSES), ";"), "").alias("http_statuses"),
        unless_failed(F.col("_bytes"), 0).cast("bigint").alias("total_bytes"),
        unless_failed(F.col("_text_len"), 0).cast("bigint").alias("total_text_len"),
        (F.length("_combined") > max_chars_full).alias("truncated_full"),
        (F.length("_combined") > preview_chars).alias("truncated_preview"),
        seconds_between(F.col("started_at"), F.col("finished_at")).alias("duration_sec"),
        "started_at",
        "finished_at",
        unless_failed(F.array_join(
            F.slice(F.transform("_pages", lambda p: p.url), 1, max_pages), ";"
        ), "").alias("visited_urls"),
        F.substring("_combined", 1, max_chars_full).alias("website_text_full"),
        F.substring("_combined", 1, preview_chars).alias("website_text_preview"),
        unless_failed(F.col("_home.main_text"), "").alias("website_text_main"),
        unless_failed(F.col("_home.title"), "").alias("site_title"),
        unless_failed(F.col("_home.meta_description"), "").alias("site_meta_description"),
        unless_failed(F.col("_home.headings"), "").alias("site_headings"),
        unless_failed(F.length("_home.main_text"), 0).alias("main_text_len"),
        unless_failed(F.greatest("_attempted", "_scraped"), 0).alias("pages_planned"),
    )
