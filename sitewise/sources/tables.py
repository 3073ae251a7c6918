"""Readers for site lists, fetches and earlier output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise import schema as S
from sitewise.functions.urls import stable_row_id
from sitewise.sources.records import cells, csv_records, file_table

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"'}


def read_site_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A site list in Parquet or CSV; raises unless it has a ``website`` column.

    CSV values stay strings. ``ord`` is the position in the file, from 0. A large CSV file is read by
    many tasks (see :mod:`sitewise.sources.records`); lists whose lines hold stray quotes and no line ends
    inside values can turn ``multi_line`` off.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        sheet = spark.read.parquet(path)
        if "ord" not in sheet.columns:
            sheet = _with_ordinal(sheet.withColumns({
                "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
            })).drop("_file", "_start")
    else:
        names = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path).columns
        rows = csv_records(spark, path, multi_line=multi_line).where(F.col("ord") > 0)
        rows = rows.select((F.col("ord") - 1).alias("_ord"), cells(F.col("record")).alias("_cells"))
        sheet = rows.select(*(F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)), "_ord")
        sheet = sheet.drop("_ord") if "ord" in names else sheet.withColumnRenamed("_ord", "ord")
    if "website" not in sheet.columns:
        raise ValueError(f"{path}: the site list needs a 'website' column")
    if "row_id" not in sheet.columns:
        sheet = sheet.withColumn("row_id", stable_row_id(F.col("website"), F.col("ord")))
    return sheet


def _with_ordinal(rows: DataFrame) -> DataFrame:
    """Position of each row in its file, from 0, as ``ord``.

    A window inside each block of a file, plus the row counts of the blocks before
    it: the size of a window is that of one input split, however large the file.
    """
    numbered = rows.withColumn("_read", F.monotonically_increasing_id())
    inside = W.partitionBy("_file", "_start").orderBy("_read")
    numbered = numbered.withColumn("ord", F.row_number().over(inside) - 1)
    earlier = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_file", "_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        numbered.join(offsets, ["_file", "_start"])
        .withColumn("ord", (F.col("ord") + F.col("_before")).cast("bigint"))
        .drop("_read", "_before")
    )


def read_site_files(
    spark: SparkSession, root: str, extension: str = ".csv", multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """All site lists under a folder, and the files which could not be used.

    Files are chosen by extension at any depth, and each goes by its own header line: they
    may differ in columns and in column order, and have any number of them. Result: ``input_file`` (the
    path below ``root``), ``ord, website, row_id, attributes`` (a map of the other columns), and the
    failures ``input_file, message``. A bad file does not stop the others: what the folder lists and what
    gave a header are compared, so an unreadable file is among the failures. An empty file counts as none. For ``multi_line``
    see :func:`read_site_list`.
    """
    glob = "*" + _any_case(extension)
    folder = root.rstrip("/").split("://")[-1].lstrip("/")
    below = F.substring_index("file", f"{folder}/", -1).alias("input_file")
    rows = csv_records(spark, root, glob, multi_line).select("file", "ord", cells(F.col("record")).alias("cells"))
    headers = rows.where(F.col("ord") == 0).select("file", F.col("cells").alias("names"))
    listed = file_table(spark, root, glob).join(headers, "file", "left").withColumn("message", F.when(
        F.col("names").isNull(), "the file could not be read"
    ).when(
        ~F.coalesce(F.array_contains("names", "website"), F.lit(False)), "the site list needs a 'website' column"
    ))
    failures = listed.where(F.col("message").isNotNull()).select(below, "message")
    usable = listed.where(F.col("message").isNull()).select("file", "names")
    body = rows.where(F.col("ord") > 0).join(usable, "file")
    # A name counts once, where it first stands.
    named = F.filter(
        F.arrays_zip("names", "cells"),
        lambda e, i: e.names.isNotNull()
        & (F.array_position("names", e.names) == (i + 1).cast("bigint")),
    )
    keyed = body.select(
        below, (F.col("ord") - 1).alias("ord"), F.map_from_entries(named).alias("_cells")
    ).withColumn("website", F.col("_cells")["website"])
    sheet = keyed.select(
        "input_file", "ord", "website",
        F.coalesce(
            F.col("_cells")["row_id"], stable_row_id(F.col("website"), F.col("ord"))
        ).alias("row_id"),
        F.map_filter(
            "_cells", lambda k, v: ~k.isin("website", "row_id") & v.isNotNull()
        ).alias("attributes"),
    )
    return sheet, failures


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_earlier_output(spark: SparkSession, path: str) -> DataFrame:
    """Earlier output, or an empty table of its schema when there is none."""
    try:
        if path.lower().rstrip("/").endswith(".csv"):
            return _typed(spark.read.options(**CSV_OPTIONS).csv(path))
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], S.SITE_OUTPUT)


def _typed(output: DataFrame) -> DataFrame:
    """Give a CSV copy the types of the output; '' comes back from CSV as null."""
    known = [f for f in S.SITE_OUTPUT if f.name in output.columns]
    return output.withColumns({
        f.name: F.coalesce(F.col(f.name), F.lit("")) if f.name in S.EMPTY_TEXT_COLUMNS
        else F.col(f.name).try_cast(f.dataType)
        for f in known
    })
