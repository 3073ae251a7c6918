from pyspark.sql import functions as F

from sitewise.operators.reports import status_counts
from sitewise.plans.site_output import site_results
from sitewise.streaming import incremental
from tests.fixtures import LONG, fetch, fetch_table, page


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_batches_equal_one_job(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    first = fetch_table(spark, [fetch(f"s{i % 3}", f"u{i}", i, page(f"{i} {LONG}")) for i in range(3, 12)])
    # comes late but stands first: it takes over as home page; and a site with too many pages
    second = fetch_table(spark, [fetch("s0", "u0", 0, page("late home")), fetch("s9", "x", 0, "")])
    many = fetch_table(spark, [fetch("s1", f"m{i}", 100 + i, page(LONG)) for i in range(40)])

    def run(folder=work):
        incremental.run_incremental_sites(
            spark, source, first.schema, folder, slices=4, max_files_per_trigger=1
        )
        return rows(incremental.current_results(spark, folder))

    first.coalesce(1).write.parquet(source)
    assert run() == rows(site_results(first))
    second.unionByName(many).coalesce(1).write.mode("append").parquet(source)
    whole = rows(site_results(first.unionByName(second).unionByName(many)))
    assert run() == whole
    assert run() == whole                                    # nothing new: nothing changes
    stored = spark.read.parquet(f"{work}/content")
    assert stored.groupBy("row_id", "batch_id").count().agg(F.max("count")).first()[0] <= 12


def test_replay_of_a_batch_replaces_it(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "row_id string, v int")
    for batch, v in ((0, 1), (1, 5), (0, 1)):
        incremental._replace_batch(table.withColumn("v", F.col("v") + v), path, batch)
    assert spark.read.parquet(path).count() == 4


def test_live_counts(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    table = spark.createDataFrame(
        [("f", "done"), ("f", None), (None, "error")], "input_file string, scrape_status string"
    )
    for _ in range(2):
        table.write.mode("append").parquet(source)
        incremental.run_live_status(spark, source, table.schema, work)
        got = incremental.live_status(spark, work)
        so_far = spark.read.parquet(source)
        assert sorted(map(str, got.collect())) == sorted(
            map(str, status_counts(so_far).select(*got.columns).collect())
        )
