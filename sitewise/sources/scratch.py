"""Where a job may put intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder of ``spark.checkpoint.dir``.

    Where the setting is missing, under the session's warehouse, which its executors
    share as well. Never a temporary folder of one machine: a warehouse on the local disk
    will do only where one machine does all the work.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        local = root.startswith(("file:", "/")) or "://" not in root
        if local and not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder which all executors share")
    return f"{root.rstrip('/')}/sitewise/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and, unlike
    a cached table, survives the loss of an executor."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
