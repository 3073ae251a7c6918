"""Tables kept as versions: a writer never touches what a reader may be reading.

A version is a folder of its own. It counts from the moment its mark is there, which is written after all
its files; a writer which stops half-way leaves a folder without a mark, which no reader sees and the next
writer replaces. So a job may write where it has read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise import schema as S

MARKS = "_marks"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it does not exist."""
    system, where = _files(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    system, where = _files(spark, path)
    system.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all: written beside its place and renamed into it."""
    system, where = _files(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.part")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(where, False)
    if not system.rename(part, where):
        raise OSError(f"{path} could not be put in its place")


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _files(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def mark(spark: SparkSession, path: str, name: str) -> None:
    """An empty file, which is there as a whole or not at all."""
    system, where = _files(spark, f"{path}/{MARKS}/{name}")
    system.create(where, True).close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    return sorted(int(n) for n in names_in(spark, f"{path}/{MARKS}") if n.isdigit())


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version:010d}"


def write_version(table: DataFrame, path: str, keep: int = 2) -> int:
    """Write the next version and return its number; ``keep`` complete ones stay, older ones go.

    The table may be made from the version before.
    """
    spark = table.sparkSession
    done = versions(spark, path)
    version = done[-1] + 1 if done else 1
    table.write.mode("overwrite").parquet(version_path(path, version))
    mark(spark, path, f"{version:010d}")
    for old in done[: max(0, len(done) + 1 - max(1, keep))]:
        # The mark goes first: a version without one does not count.
        remove(spark, f"{path}/{MARKS}/{old:010d}")
        remove(spark, version_path(path, old))
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A complete version, the newest unless told; None if there is none."""
    done = versions(spark, path)
    if version is None and done:
        version = done[-1]
    return spark.read.parquet(version_path(path, version)) if version in done else None


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """The newest result table, or an empty one of its schema."""
    found = read_version(spark, path)
    return spark.createDataFrame([], S.SITE_OUTPUT) if found is None else found


def write_done_ids(output: DataFrame, path: str, keep: int = 2) -> int:
    """The checkpoint of a result table: ids of finished rows, sorted, with the time of writing."""
    done = output.where(F.col("scrape_status") == "done").select("row_id").distinct()
    return write_version(done.withColumn("updated_at", F.current_timestamp()).sort("row_id"), path, keep)


def read_done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the newest checkpoint; none if there is none."""
    found = read_version(spark, path)
    return spark.createDataFrame([], "row_id string, updated_at timestamp") if found is None else found
