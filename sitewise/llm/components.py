"""Connected components of an edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.sources.scratch import stored


def _forest(batches):
    """Union-find over one task's edges; its memory is that of one partition."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    tips = [(x, find(x)) for x in list(root)]
    yield pd.DataFrame({"u": [x for x, _ in tips], "v": [y for _, y in tips]}, dtype="int64")


#: Edges which one task solves; its union-find takes some 200 bytes for each.
ONE_TASK = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (two long columns).

    Up to ``ONE_TASK`` edges, after each task has reduced its own to stars, are solved by one task, whose
    memory they bound. Beyond that each round hangs every node's larger neighbours, then every node's neighbours, onto the
    smallest of them; pre-aggregated minima, no node's neighbours in one row. Rounds grow with the logarithm of the
    longest path. Ends when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    # Within each task first: of what a task reads, a star per component is left.
    e = stored(e.mapInPandas(_forest, "u long, v long").distinct(), "edges")
    if e.count() <= one_task:
        e = stored(e.coalesce(1).mapInPandas(_forest, "u long, v long").where("u <> v"), "edges")
        return _stars(e)
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"), "u", "m")
        e = stored(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))).distinct(), "edges",
        )
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return _stars(e)


def _stars(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
