"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions.text import iso_utc


def write_sites(table: DataFrame, path: str) -> None:
    """The result table, in its own types."""
    table.write.mode("overwrite").parquet(path)


def export_csv(table: DataFrame, path: str) -> None:
    """A CSV copy which survives quotes and line ends; times as ISO with 'Z'."""
    times = [f.name for f in table.schema if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    table.withColumns({c: iso_utc(F.col(c)) for c in times}).write.mode("overwrite").options(
        header="true", escape='"',
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def write_checkpoint(output: DataFrame, path: str) -> None:
    """Ids of finished rows, sorted, with the time of writing."""
    done = output.where(F.col("scrape_status") == "done").select("row_id").distinct()
    done.withColumn("updated_at", F.current_timestamp()).sort("row_id").write.mode(
        "overwrite"
    ).parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Report rows as JSON lines; times with all their digits."""
    summary.write.mode("overwrite").options(
        timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).json(path)
