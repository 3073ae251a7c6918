"""Running totals which do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of whole numbers per key, in order.

    ``bucket`` must rise with ``order`` and split a group into parts which fit a task
    (a time slice, a range of positions).  Sums run inside each part; the totals
    of earlier parts, a small table, are added by a join.  ``totals`` maps a sum's
    name to a new column with its total over the whole key.
    """
    data = df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        data = data.withColumn(f"_v_{name}", value.cast("bigint"))
    parts = data.groupBy(*keys, "_bucket").agg(
        *(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums)
    )
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys),
        F.col("_bucket").alias("_k_bucket"),
        *(F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums),
        *(F.sum(f"_p_{n}").over(whole).alias(t) for n, t in (totals or {}).items()),
    )
    inside = (
        W.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = data.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in sums))
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    match.append(F.col("_bucket").eqNullSafe(F.col("_k_bucket")))
    joined = local.join(offsets, match, "inner")
    return joined.select(
        *df.columns,
        *((F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums),
        *(totals or {}).values(),
    )
