"""CSV records of files of any size, each file read by many tasks.

A record may hold line ends inside quotes, so a reader which starts in the middle of a file can't tell
where a record ends. But quotes come in pairs (a quote inside a value is doubled): a line begins a record
just if the number of quotes before it in its file is even. Lines are counted within each block of a
file, block totals are summed up, and both together give each line its parity and its record's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A cell and the comma or the end behind it. Possessive: linear on long cells.
CELL = r'("(?:[^"]++|"")*+"[^,]*+|[^,]*+)(?:,|\z)'


def file_table(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(file) of the files below a folder, from their listing alone; Spark lists no empty files."""
    listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=glob).load(root)
    return listed.select(F.col("_metadata.file_path").alias("file"))


def csv_records(spark: SparkSession, root: str, glob: str = "*", multi_line: bool = True) -> DataFrame:
    """(file, ord, record) of all files below a folder, or of one file; ``ord`` counts from 0.

    Records are as in RFC 4180: a cell with a comma, a quote or a line end stands in quotes. Empty lines
    between records are no records. A byte order mark and the carriage return before a line end go. A
    file which can't be read has no records; one that is cut short has those which could be read. Quotes
    that are not paired run on to the next one, over line ends. Without ``multi_line`` every line is a
    record.
    """
    lines = spark.read.options(
        lineSep="\n", recursiveFileLookup="true", pathGlobFilter=glob, ignoreCorruptFiles="true",
    ).text(root).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes % 2 if multi_line else F.lit(0))
    block = W.partitionBy("file", "block").orderBy("nth")
    inside = lines.withColumn("nth", F.monotonically_increasing_id()).withColumns({
        "odd": F.coalesce(F.sum("quotes").over(block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2,
    })
    # Whether the quotes of the blocks before are paired turns over which lines begin records, so both
    # numbers of records are counted for each block.
    begins, turned = _begins(F.col("odd"), F.col("line")), _begins(1 - F.col("odd"), F.col("line"))
    upto = block.rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumns({"records": F.sum(begins).over(upto), "records_turned": F.sum(turned).over(upto)})
    totals = _block_totals(lines)
    numbered = inside.join(totals, ["file", "block"])
    flipped = F.col("odd_before") == 1
    placed = numbered.select(
        "file", "nth", "line",
        (F.col("records_before") + F.when(flipped, F.col("records_turned")).otherwise(F.col("records")) - 1).alias("ord"),
        ((F.col("odd") + F.col("odd_before")) % 2 == 0).alias("starts"), "block",
    ).where((F.col("ord") >= 0) & ~(F.col("starts") & _blank(F.col("line"))))
    whole = placed.groupBy("file", "ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "line"))), lambda x: x["line"]), "\n").alias("record")
    )
    mark = F.when(F.col("ord") == 0, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return whole.select("file", F.col("ord").cast("bigint").alias("ord"), F.regexp_replace(mark, "\r$", "").alias("record"))


def _blank(line: Column) -> Column:
    return F.regexp_replace(line, "[\r\ufeff]", "") == ""


def _begins(odd: Column, line: Column) -> Column:
    return F.when((odd == 0) & ~_blank(line), 1).otherwise(0)


def _block_totals(lines: DataFrame) -> DataFrame:
    """Per block of a file the parity of the quotes before it, and the number of records begun before it.

    A block has one row here; a file has one for each input split.
    """
    block = W.partitionBy("file", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    counted = lines.withColumn("nth", F.monotonically_increasing_id()).withColumn(
        "odd", F.coalesce(F.sum("quotes").over(block), F.lit(0)) % 2
    ).groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("odd"), F.sum(_begins(F.col("odd"), F.col("line"))).alias("records"),
        F.sum(_begins(1 - F.col("odd"), F.col("line"))).alias("records_turned"),
    )
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    parity = counted.withColumn("odd_before", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
    own = F.when(F.col("odd_before") == 1, F.col("records_turned")).otherwise(F.col("records"))
    return parity.select("file", "block", "odd_before", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("records_before"))


def cells(record: Column) -> Column:
    """The cells of a record, however many; an empty cell is null, one of two quotes is empty."""
    found = F.regexp_extract_all(record, F.lit(CELL), F.lit(1))
    # Where the record does not end in a comma, the pattern matches once more at its very end.
    kept = F.when(record.endswith(","), found).otherwise(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))))
    return F.transform(kept, lambda c: F.when(c == "", F.lit(None).cast("string")).when(
        c.startswith('"'), F.replace(F.regexp_extract(c, r'(?s)^"(.*)"', 1), F.lit('""'), F.lit('"'))
    ).otherwise(c))
