"""Resume from earlier output and write results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise import schema as S


def conform(df: DataFrame) -> DataFrame:
    """Add the output columns which are missing; present ones keep their place."""
    missing = [f for f in S.SITE_OUTPUT if f.name not in df.columns]
    return df.select("*", *(
        F.lit("" if f.name in S.EMPTY_TEXT_COLUMNS else None).cast(f.dataType).alias(f.name)
        for f in missing
    ))


def first_per_id(earlier: DataFrame, order: str | None = None) -> DataFrame:
    """First earlier row of each id; copies are cut ahead of the exchange.

    ``order`` ranks as a number. Without it finished rows go first, then the latest.
    """
    if order in earlier.columns:
        keys = [F.col(order).cast("double").asc_nulls_last()]
    else:
        known = [c for c in ("scrape_status", "finished_at", "normalized_url") if c in earlier.columns]
        keys = [(F.col(c) == "done").desc_nulls_last() if c == "scrape_status" else F.col(c).desc_nulls_last() for c in known]
    by_order = W.partitionBy("row_id").orderBy(*(keys or ["row_id"]))
    return earlier.withColumn("_n", F.row_number().over(by_order)).where(F.col("_n") == 1).drop("_n")


def resume_merge(sheet: DataFrame, earlier: DataFrame | None, order: str | None = "ord") -> DataFrame:
    """Input left-joined to its earlier output, conformed.

    A column in both keeps the input's value unless that is null; the others are
    carried over.  ``order``, if the earlier output has it, ranks rows of one id and is dropped.
    """
    if earlier is None or "row_id" not in earlier.columns:
        return conform(sheet)
    old = first_per_id(earlier, order).drop(*([order] if order else []))
    shared = [c for c in sheet.columns if c in old.columns and c != "row_id"]
    renamed = old.select([
        F.col(c).alias(f"_old_{c}") if c in shared else F.col(c) for c in old.columns
    ])
    merged = sheet.join(renamed, "row_id", "left")
    return conform(merged.select(
        *(F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in shared else F.col(c)
          for c in sheet.columns),
        *(c for c in old.columns if c not in sheet.columns),
    ))


def is_pending(status: Column) -> Column:
    return F.coalesce(status, F.lit("")) != "done"


def pending_sites(sheet: DataFrame, output: DataFrame) -> DataFrame:
    """Input rows with no output row whose status is done."""
    done = output.where(~is_pending(F.col("scrape_status"))).select("row_id")
    return sheet.join(done, "row_id", "left_anti")


def stale_checkpoint_ids(checkpoint: DataFrame, output: DataFrame) -> DataFrame:
    """Checkpoint ids which the output does not show as done; they run again."""
    done = output.where(~is_pending(F.col("scrape_status"))).select("row_id")
    return checkpoint.select("row_id").join(done, "row_id", "left_anti")


def upsert_results(table: DataFrame, results: DataFrame) -> DataFrame:
    """Replace the result columns of every row which has a new result.

    ``results`` has one row per ``row_id``; several table rows may share an id and all
    get it.  A null in a new result counts: the row is replaced as a whole.
    """
    columns = [c for c in results.columns if c != "row_id"]
    marked = results.select(
        "row_id", F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in columns)
    )
    joined = table.join(marked, "row_id", "left")
    kept = [c for c in table.columns if c not in columns]

    def value(c: str) -> Column:
        old = F.col(c) if c in table.columns else F.lit(None)
        return F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(old).alias(c)

    return joined.select(*kept, *map(value, columns))
