import random

from pyspark.sql import functions as F

from sitewise.operators import reports
from sitewise.operators.prefix import prefix_sums


def skewed(spark, n=6000):
    """One key holds nine tenths of the rows, one is null, one row has a null order."""
    rng = random.Random(3)
    data = [("hot" if i % 10 else (None if i % 20 else f"k{i % 7}"), None if i == 11 else (i * 7919) % n, rng.randint(0, 9)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, n int, v int").repartition(5)


def plain(data):
    want, sums = [], {}
    for k, n, v in sorted(data, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1])):
        sums[k] = sums.get(k, 0) + v
        want.append((k, n, v, sums[k]))
    return sorted(want, key=repr), sums


def test_parts_give_what_one_window_gives(spark):
    data, table = skewed(spark)
    want, sums = plain(data)
    for size in (50, 700, 100_000):
        got = prefix_sums(table, ["k"], ["n"], {"s": F.col("v")}, {"s": "all"}, rows_per_part=size).collect()
        assert sorted([(r.k, r.n, r.v, r.s) for r in got], key=repr) == want
        assert {(r.k, r["all"]) for r in got} == set(sums.items())


def test_a_hot_key_is_split_and_the_rows_move_once(spark):
    _, table = skewed(spark)
    wide = table.withColumn("payload", F.concat("k", F.lit("x")))
    out = prefix_sums(wide, ["k"], ["n"], {"s": F.col("v")}, rows_per_part=200)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    fed = [below for line, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in line]
    # The window's exchange carries the rows, the others sums by part.
    assert sum("payload" in line for line in fed) == 1
    assert len(fed) == 3 and sum("HashAggregate" in line for line in fed) == 2
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.5 * 6000


def test_without_keys_and_empty(spark):
    table = spark.range(1000).select(F.col("id").alias("n"))
    for size in (90, 5000):
        got = prefix_sums(table, [], ["n"], {"s": F.lit(1)}, {"s": "all"}, rows_per_part=size).collect()
        assert [(r.n, r.s, r["all"]) for r in sorted(got)] == [(i, i + 1, 1000) for i in range(1000)]
    assert prefix_sums(table.where("n < 0"), ["n"], ["n"], {"s": F.lit(1)}).count() == 0


def test_ties_and_nulls_keep_the_totals(spark):
    table = spark.createDataFrame([("a", 1, None)] * 300 + [("a", 1, 2)] * 300, "k string, n int, v int")
    got = prefix_sums(table, ["k"], ["n"], {"s": F.col("v"), "c": F.lit(1)}, rows_per_part=50)
    assert sorted(r.c for r in got.collect()) == list(range(1, 601))
    assert got.agg(F.max("s")).first()[0] == 600


def test_time_budget_and_progress_need_no_bucket(spark):
    log = spark.createDataFrame([("a", i, 0.1) for i in range(900)] + [("b", 0, 50.0), ("b", 1, 1.0)], "row_id string, n int, elapsed_sec double")
    for size in (100, 10_000):
        kept = reports.site_time_budget(log, None, ["n"], 45, rows_per_part=size)
        assert kept.where("row_id = 'a'").agg(F.count("*"), F.max("spent_ms")).first() == (451, 45_000)
        assert kept.where("row_id = 'b'").count() == 1
    results = log.select(F.lit("f").alias("input_file"), "n", "row_id", F.lit("done").alias("scrape_status")).where("row_id = 'a'")
    shown = reports.progress_timeline(results, None, ["n"], 100, rows_per_part=150)
    assert sorted((r.processed, r.done, r.rows_total) for r in shown.collect()) == [(i, i, 900) for i in range(100, 901, 100)]
