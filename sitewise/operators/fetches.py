"""One record per page of a site, from all the times it was fetched.

A page may have been fetched plainly, again after a failure, and by a browser. What was seen of it is
kept as a state of narrow columns, which merge in any order: an aggregate which runs ahead of its exchange
in a batch job, and the step from batch to batch of an incremental one. A state names the fetch whose
content stands; only that fetch's wide row is looked up, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions import html as H
from sitewise.operators.bloom import may_match

PAGE, IDS = ["row_id", "url"], ["_id1", "_id2"]
#: The narrow state of a page beside its key. The structs begin with what they are ordered by.
STATE = ["pos", "elapsed_sec", "fetched_at", "last_fetched_at", "fetch_count", "stands", "plain", "latest", "failed"]
#: What a record takes from its state; all other columns are the standing fetch's.
SETTLED = ("pos", "status_code", "error", "elapsed_sec", "fetched_at", "last_fetched_at", "fetch_count")


def identified(fetches: DataFrame) -> DataFrame:
    """Fetches with two hashes over all their columns, which name them in every pass."""
    columns = [F.col(c) for c in fetches.columns]
    return fetches.withColumns({"_id1": F.xxhash64(F.lit(5), *columns), "_id2": F.xxhash64(F.lit(6), *columns)})


def _by_browser() -> Column:
    return F.coalesce(F.col("method") == K.BROWSER_METHOD, F.lit(False))


def _rank(fetches: DataFrame) -> Column:
    """2 for content from a browser, 1 for usable content from a plain fetch, else 0."""
    if "html" in fetches.columns:
        there = F.coalesce(F.col("html") != "", F.lit(False))
        fit = F.coalesce(H.is_html(F.col("status_code"), F.col("content_type")), F.lit(False))
    else:
        there, fit = F.col("has_html"), F.lit(True)
    return F.when(there & _by_browser(), 2).when(there & fit, 1).otherwise(0)


def page_states(fetches: DataFrame) -> DataFrame:
    """The state after each one of :func:`identified` fetches, or of their content."""
    told = F.struct("status_code", "error", F.nullif(F.col("final_url"), F.lit("")).alias("final_url"))
    seen = F.struct("fetched_at", *IDS, told.alias("told"))
    rank = _rank(fetches)
    return fetches.select(
        *PAGE, "pos", "elapsed_sec", "fetched_at", F.col("fetched_at").alias("last_fetched_at"),
        F.lit(1).cast("bigint").alias("fetch_count"),
        F.struct(rank.alias("rank"), "fetched_at", *IDS, told.alias("told")).alias("stands"),
        F.when(~_by_browser(), seen).alias("plain"), seen.alias("latest"),
        F.when(_by_browser() & (rank == 0), seen).alias("failed"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per page; any grouping of the same states gives the same."""
    return states.groupBy(*PAGE).agg(
        F.min("pos").alias("pos"), F.sum("elapsed_sec").alias("elapsed_sec"), F.min("fetched_at").alias("fetched_at"),
        F.max("last_fetched_at").alias("last_fetched_at"), F.sum("fetch_count").alias("fetch_count"),
        *(F.max(c).alias(c) for c in ("stands", "plain", "latest", "failed")),
    )


def records_of(states: DataFrame, *carried: str) -> DataFrame:
    """One narrow row per page, with the ids of the standing fetch and the columns ``carried``.

    The standing fetch is the latest by a browser which has content, else the latest plain one with
    usable content, else the latest. ``status_code`` and ``error`` are a plain standing fetch's own; where
    a browser's stands (it has no status of its own) or none has content, the latest plain fetch's. The
    error of the latest failed rendering is added unless another succeeded. Times add up, ``pos`` is the
    smallest, ``fetched_at`` the first time and ``last_fetched_at`` the last. A page fetched once keeps its
    values. Null URLs are one page.
    """
    rank, plain = F.col("stands.rank"), F.col("plain.told")
    known = F.when(rank == 1, F.col("stands.told")).otherwise(F.coalesce(plain, F.col("latest.told")))
    rendering = F.when((rank < 2) & plain.isNotNull(), F.nullif(F.col("failed.told.error"), F.lit("")))
    return states.withColumn("_known", known).select(
        *PAGE, "pos", F.col("_known.status_code").alias("status_code"),
        F.trim(F.concat_ws(" ", F.nullif(F.col("_known.error"), F.lit("")), rendering)).alias("error"),
        "elapsed_sec", "fetched_at", "last_fetched_at", "fetch_count",
        F.col("_known.final_url").alias("_landed"), *(F.col(f"stands.{c}").alias(c) for c in IDS), *carried,
    )


def merged_records(fetches: DataFrame) -> DataFrame:
    """The record of every page in :func:`identified` fetches, or in their content."""
    return records_of(merged_states(page_states(fetches)))


def standing(fetches: DataFrame, records: DataFrame) -> DataFrame:
    """The standing fetches of some records, which should be stored; identified, other fetches dropped.

    A Bloom filter of the records' fetches drops nearly all others where the table is scanned, ahead of
    text extraction and exchange; the join to come is exact.
    """
    return may_match(identified(fetches), records, IDS)


def with_records(wide: DataFrame, records: DataFrame) -> DataFrame:
    """Each record once, with the columns of its standing fetch (which may have content for ``html``)."""
    kept = [c for c in wide.columns if c not in (*SETTLED, *IDS, *PAGE, "final_url")]
    own = F.nullif(F.col("final_url"), F.lit("")).alias("final_url")
    # Two fetches which are equal in all columns have the same ids: one of them counts.
    one = wide.select(*IDS, own, *kept).join(records, IDS).dropDuplicates(IDS)
    return one.select(
        *PAGE, F.coalesce("final_url", "_landed", F.lit("")).alias("final_url"), *kept,
        *(c for c in records.columns if c not in (*IDS, *PAGE, "_landed")),
    )


def wide_columns(content: DataFrame) -> list[str]:
    """Columns which a record has from its standing fetch, ``final_url`` among them."""
    return [c for c in content.columns if c not in (*SETTLED, *IDS, *PAGE, *STATE)]


def carry_on(old: DataFrame | None, content: DataFrame, limit) -> DataFrame:
    """New content of some pages (:func:`identified`, stored) merged with what was kept of them before.

    Result and ``old``: one row per page with its state and the wide columns of its standing fetch.
    ``limit`` cuts the pages of a site on narrow columns.
    """
    wide = wide_columns(content)
    states, pool = page_states(content), content.select(*IDS, *wide)
    if old is not None:
        states = states.unionByName(old.select(*PAGE, *STATE))
        pool = pool.unionByName(old.select(*(F.col(f"stands.{c}").alias(c) for c in IDS), *wide))
    kept = limit(merged_states(states)).withColumns({c: F.col(f"stands.{c}") for c in IDS})
    return kept.join(pool, IDS).dropDuplicates(IDS).select(*PAGE, *STATE, *wide)


def kept_records(kept: DataFrame) -> DataFrame:
    """The records of what :func:`carry_on` gave."""
    wide = wide_columns(kept)
    landed = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("_landed"), F.lit(""))
    return records_of(kept, *wide).withColumn("final_url", landed).drop("_landed", *IDS)


def merge_fetches(fetches: DataFrame) -> DataFrame:
    """One row per (row_id, url), see :func:`records_of`; ``last_fetched_at`` and ``fetch_count`` added."""
    marked = identified(fetches)
    return with_records(marked, merged_records(marked))
