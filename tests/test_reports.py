import random

from pyspark.sql import functions as F

from sitewise.operators import reports
from sitewise.operators.running import running_totals


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_counts(spark):
    data = [("f1", "done"), ("f1", "done"), ("f1", None), ("f2", "error"), (None, "skipped")]
    table = spark.createDataFrame(data, "input_file string, scrape_status string")
    counts = ("rows_total", "rows_done", "rows_error", "rows_skipped")
    assert rows(reports.status_counts(table), "input_file", *counts) == [
        ("f1", 3, 2, 0, 0), ("f2", 1, 0, 1, 0), (None, 1, 0, 0, 1),
    ]
    rolled = reports.status_rollup(table)
    assert rows(rolled.where("is_total"), *counts, "rows_pending") == [(5, 2, 1, 1, 1)]
    assert rolled.where("not is_total and input_file is null").count() == 1
    assert rolled.where("not is_total").agg(F.sum("rows_total")).first()[0] == len(data)
    summary = reports.run_summary(table)
    assert rows(summary.where("kind = 'totals'"), "rows_total", "rows_pending") == [(5, 1)]


def test_progress(spark):
    data = [("f", i, s) for i, s in enumerate(["done", "error", "done", "skipped", None])]
    table = spark.createDataFrame(data, "input_file string, n int, scrape_status string")
    got = reports.progress_timeline(table, F.col("n").cast("int") % 100 > 2, ["n"], save_every=2)
    assert rows(got, "processed", "done", "error", "skipped", "pending") == [
        (2, 1, 1, 0, 3), (4, 2, 1, 1, 1), (5, 2, 1, 1, 1),
    ]


def test_running_totals_of_a_hot_key(spark):
    """One key holds most rows, another is null; parts give what one window would."""
    rng = random.Random(1)
    data = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 9)) for i in range(3000)]
    table = spark.createDataFrame(data, "k string, n int, v int").repartition(7)
    got = running_totals(table, ["k"], F.floor(F.col("n") / 100), ["n"], {"total": F.col("v")}, {"total": "all"})
    want, sums = [], {}
    for k, n, v in data:
        sums[k] = sums.get(k, 0) + v
        want.append((k, n, v, sums[k]))
    assert rows(got, "k", "n", "v", "total") == sorted(want, key=repr)
    assert {(r.k, r["all"]) for r in got.select("k", "all").distinct().collect()} == set(sums.items())


def test_time_budget(spark):
    data = [("a", i, e) for i, e in enumerate([20.0, 20.0, 10.0, 5.0])] + [("b", 0, 100.0), ("b", 1, 0.1)]
    log = spark.createDataFrame(data, "row_id string, n int, elapsed_sec double")
    for width in (1, 2, 100):
        kept = reports.site_time_budget(log, F.floor(F.col("n") / width), ["n"], 45)
        assert rows(kept, "row_id", "n", "spent_ms") == [
            ("a", 0, 0), ("a", 1, 20000), ("a", 2, 40000), ("b", 0, 0),
        ]


def test_retry(spark):
    data = [("a", "u", 1, 503), ("a", "u", 2, 429), ("a", "v", 1, 500), ("a", "v", 2, 200), ("a", "w", 1, 404)]
    data += [("a", "x", i, 503) for i in range(4)]
    log = spark.createDataFrame(data, "row_id string, url string, n int, status_code int")
    assert rows(reports.retry_queue(log, F.col("n")), "url", "failures", "last_status") == [("u", 2, 429)]


def test_failures(spark):
    table = spark.range(30).select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"))
    got = {r.message: r.failures for r in reports.failure_sample(table, ["id"]).collect()}
    assert len(got) == 26 and got["... and 5 more"] == 5 and "m24" in got and "m25" not in got
    assert reports.failure_sample(table.where("id < 25"), ["id"]).count() == 25


def test_busy_time_of_overlapping_spans(spark):
    import datetime as dt

    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    data = [("hot" if i % 8 else None, rng.randint(0, 3000), rng.randint(-2, 9)) for i in range(900)] + [("gap", 0, 1), ("gap", 1, 2), ("gap", 10, 5), ("none", 4, 0)]
    rows = [(k, start + dt.timedelta(seconds=a), start + dt.timedelta(seconds=a + n)) for k, a, n in data] + [("hot", None, start)]
    spans = spark.createDataFrame(rows, "f string, started_at timestamp, finished_at timestamp")
    want = {}
    for k, a, n in data:
        want.setdefault(k, set()).update(range(a, a + max(0, n)))
    for size in (100, 10_000):
        got = {r.f: r.busy for r in reports.busy_time(spans, ["f"], rows_per_part=size).collect()}
        assert got == {k: 1_000_000 * len(v) for k, v in want.items() if v}


def test_run_report(spark):
    import datetime as dt

    def at(n):
        return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)

    data = [("f", "done", at(0), at(10)), ("f", "error", at(5), at(20)), ("g", "done", at(100), at(101)), ("g", None, None, None), (None, "done", at(15), at(30))]
    output = spark.createDataFrame(data, "input_file string, scrape_status string, started_at timestamp, finished_at timestamp")
    failures = spark.createDataFrame([("bad.csv", "no website column"), ("worse.csv", None)], "input_file string, message string")
    got = reports.run_summary(output, failures).collect()
    files = {r.input_file: (r.rows_total, r.rows_pending, r.duration_sec, r.busy_sec) for r in got if r.kind == "file"}
    assert files == {"f": (2, 0, 20.0, 20.0), "g": (2, 1, 1.0, 1.0), None: (1, 0, 15.0, 15.0)}
    total, = (r for r in got if r.kind == "totals")
    assert (total.rows_total, total.duration_sec, total.busy_sec) == (5, 101.0, 31.0)
    assert (total.files_total, total.files_completed, total.files_failed) == (4, 1, 2)
    assert sorted(r.input_file for r in got if r.kind == "failure") == ["bad.csv", "worse.csv"]
    empty = reports.run_summary(output.limit(0)).collect()
    assert [(r.kind, r.rows_total, r.files_total) for r in empty] in ([], [("totals", 0, 0)])
