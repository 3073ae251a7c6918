"""Running sums over groups of any size, without a bucket given by the caller.

A group which fits a task is one window. Of a larger one the order itself is cut into parts: a
sample of its order values gives the borders, sums run inside each part, and the totals of the
parts before it (a small table) are added. Borders decide only how evenly the rows spread; any
borders give the same sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise.sources.scratch import stored

#: Rows of one key which one task may order. There are at most rows / ROWS_PER_PART borders,
#: which bounds what is broadcast: 2,000 of them for a thousand million rows.
ROWS_PER_PART = 500_000
#: Sampled rows for each part to come.
SAMPLES = 24
#: Borders looked through at once; the first look goes over every STEP-th border.
STEP = 64


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Add inclusive running sums of whole numbers per key, in ascending order.

    Null keys form a group, null order values come first, null values count as 0. ``order``
    should be unique within a key; rows which tie have one order, but which is left open.
    ``totals`` maps a sum's name to a new column with its total over the whole key. Without
    ``keys`` the table is one group. The rows go through one exchange, on (keys, part).
    """
    totals = totals or {}
    data = df.withColumns({f"_v_{n}": F.coalesce(v.cast("bigint"), F.lit(0)) for n, v in sums.items()})
    large = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_part)
    large = stored(large, "prefix-large")
    if large.isEmpty():
        return _within(data, keys, order, sums, totals).select(*df.columns, *sums, *totals.values())
    borders = stored(_borders(data, large, keys, order, rows_per_part), "prefix-borders")
    offsets = _offsets(_parted(data, keys, order, borders, "inner"), keys, sums, totals)
    inside = _within(_parted(data, keys, order, borders, "left"), [*keys, "_part"], order, sums, totals)
    joined = _match(inside, F.broadcast(offsets), [*keys, "_part"], "left")
    return joined.select(
        *df.columns,
        *((F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums),
        *(F.coalesce(F.col(f"_t_{n}"), F.col(t)).alias(t) for n, t in totals.items()),
    )


def _within(data: DataFrame, keys: list[str], order: list[str], sums, totals) -> DataFrame:
    whole = W.partitionBy(*keys)
    so_far = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return data.select(
        "*", *(F.sum(f"_v_{n}").over(so_far).alias(n) for n in sums),
        *(F.sum(f"_v_{n}").over(whole).alias(t) for n, t in totals.items()),
    )


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join for which nulls are equal; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] or [F.lit(True)]
    return left.join(renamed, on, how).drop(*(f"_k_{k}" for k in keys))


def _borders(data: DataFrame, large: DataFrame, keys: list[str], order: list[str], rows_per_part: int) -> DataFrame:
    """Per large key its sorted borders, and every STEP-th of them."""
    of_large = _match(data.select(*keys, *order), F.broadcast(large), keys, "inner")
    share = min(1.0, SAMPLES / rows_per_part)
    some = of_large.where(F.rand(7) < share).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("_all"), F.max("_rows").alias("_rows")
    )
    step = F.greatest(F.lit(1), F.floor(F.size("_all") * rows_per_part / F.col("_rows"))).cast("int")
    borders = F.array_distinct(F.filter("_all", lambda x, i: (i + 1) % step == 0))
    return some.select(*keys, borders.alias("_borders")).withColumn(
        "_heads", F.filter("_borders", lambda x, i: (i + 1) % STEP == 0)
    )


def _parted(data: DataFrame, keys: list[str], order: list[str], borders: DataFrame, how: str) -> DataFrame:
    """Number the part of each row of a large key; other keys get null, or go with an inner join."""
    found = _match(data, F.broadcast(borders), keys, how)
    own = F.struct(*order)
    skipped = F.size(F.filter("_heads", lambda x: x <= own)) * STEP
    near = F.slice("_borders", F.col("_skipped") + 1, F.lit(STEP))
    return found.withColumn("_skipped", skipped).withColumn(
        "_part", F.when(F.col("_borders").isNotNull(), F.col("_skipped") + F.size(F.filter(near, lambda x: x <= own)))
    ).drop("_borders", "_heads", "_skipped")


def _offsets(parted: DataFrame, keys: list[str], sums, totals) -> DataFrame:
    """Per part of a large key the sums of the parts before it, and the key's totals."""
    parts = parted.groupBy(*keys, "_part").agg(*(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums))
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        *keys, "_part",
        *(F.sum(f"_p_{n}").over(earlier).alias(f"_o_{n}") for n in sums),
        *(F.sum(f"_p_{n}").over(whole).alias(f"_t_{n}") for n in totals),
    )
