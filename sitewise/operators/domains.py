"""Registrable domains with a suffix list kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions import urls as U


def with_domain(df: DataFrame, url: str, suffixes: DataFrame, name: str = "domain") -> DataFrame:
    """Add the registrable domain of ``url`` by a join with ``suffixes(suffix)``.

    Only distinct network locations are matched against the list, however often
    they occur.  Sizes are left to Spark: no side is forced to broadcast.
    """
    located = df.withColumn("_location", U.netloc(F.col(url)))
    tails = located.select("_location").distinct().select(
        "_location",
        F.posexplode(U._tails(U.host_of(F.col("_location")))).alias("_at", "_tail"),
    )
    keyed = tails.select("_location", "_at", "_tail", F.explode(F.array(
        F.struct(F.col("_tail").alias("key"), F.lit(False).alias("exempt")),
        F.struct(F.concat(F.lit("*."), U.parent(F.col("_tail"))).alias("key"), F.lit(False).alias("exempt")),
        F.struct(F.concat(F.lit("!"), F.col("_tail")).alias("key"), F.lit(True).alias("exempt")),
    )).alias("_rule")).select("_location", "_at", "_tail", "_rule.*")
    rules = suffixes.select(F.lower("suffix").alias("key")).distinct()
    matched = (
        keyed.join(rules, "key")
        .groupBy("_location", "_at")
        .agg(F.bool_or("exempt").alias("exempt"))
        .where(~F.col("exempt"))
        .groupBy("_location")
        .agg(F.min("_at").alias("_suffix_at"))
        .where(F.col("_suffix_at") > 0)
    )
    domains = matched.select("_location", F.get(
        U._tails(U.host_of(F.col("_location"))), F.col("_suffix_at") - 1
    ).alias("_domain"))
    return (
        located.join(domains, "_location", "left")
        .withColumn(name, F.coalesce("_domain", "_location"))
        .drop("_location", "_domain")
    )
