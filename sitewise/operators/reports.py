"""Budgets over fetch logs, retries, progress, counts and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions.text import seconds_between, to_millis
from sitewise.operators.prefix import ROWS_PER_PART, prefix_sums
from sitewise.operators.running import running_totals


def site_time_budget(
    log: DataFrame,
    bucket: Column | None,
    order: list[str],
    budget_sec: float = K.TIME_BUDGET_SEC,
    delay_sec: float = 0.0,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Fetches of a log for which the site's time before them is within budget.

    For logs of any length; ``spent_ms`` is the time before the fetch. Without a ``bucket`` the
    log of a large site is cut by its own order.
    """
    log = log.withColumn("_ms", to_millis(F.col("elapsed_sec")) + round(delay_sec * 1000))
    run = _running(log, ["row_id"], bucket, order, {"_sum": F.col("_ms")}, None, rows_per_part)
    return (
        run.withColumn("spent_ms", F.col("_sum") - F.col("_ms"))
        .where(F.col("spent_ms") <= round(budget_sec * 1000))
        .drop("_ms", "_sum")
    )


def _running(df, keys, bucket, order, sums, totals, rows_per_part) -> DataFrame:
    if bucket is None:
        return prefix_sums(df, keys, order, sums, totals, rows_per_part)
    return running_totals(df, keys, bucket, order, sums, totals)


def retry_queue(log: DataFrame, order: Column, max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """URLs whose latest status is worth another try and which have tries left."""
    retryable = F.col("status_code").isin(*K.RETRY_STATUSES)
    return (
        log.groupBy("row_id", "url")
        .agg(
            F.count_if(retryable).alias("failures"),
            F.max_by("status_code", order).alias("last_status"),
        )
        .where(
            F.col("last_status").isin(*K.RETRY_STATUSES) & (F.col("failures") <= max_retries)
        )
    )


def _counts() -> list[Column]:
    status = F.col("scrape_status")
    return [
        F.count(F.lit(1)).alias("rows_total"),
        *(F.count_if(status == s).alias(f"rows_{s}") for s in ("done", "error", "skipped")),
    ]


def _with_pending(counts: DataFrame) -> DataFrame:
    finished = F.col("rows_done") + F.col("rows_error") + F.col("rows_skipped")
    return counts.withColumn(
        "rows_pending", F.greatest(F.lit(0), F.col("rows_total") - finished)
    )


def status_counts(output: DataFrame) -> DataFrame:
    """Rows by status for every input file; rows without a file form a group."""
    return output.groupBy("input_file").agg(*_counts())


def status_rollup(output: DataFrame) -> DataFrame:
    """Counts per file and over all files, with what is pending.

    ``is_total`` tells the total from the group of rows without a file.
    """
    rolled = output.rollup("input_file").agg(
        *_counts(), (F.grouping_id() == 1).alias("is_total")
    )
    return _with_pending(rolled)


def failure_sample(failures: DataFrame, order: list[str], limit: int = K.MAX_FAILURES) -> DataFrame:
    """The first failures and one line for the rest.

    ``failures`` holds ``message``.  The order is settled by a distributed top-k, and
    the rest by a count; nothing is ranked as a whole.
    """
    head = failures.orderBy(*order).limit(limit).select("message", F.lit(1).cast("bigint").alias("failures"))
    rest = failures.agg((F.count(F.lit(1)) - limit).alias("failures")).where(F.col("failures") > 0)
    tail = rest.select(
        F.concat(F.lit("... and "), F.col("failures").cast("string"), F.lit(" more")).alias("message"),
        "failures",
    )
    return head.unionByName(tail)


def progress_timeline(
    results: DataFrame, bucket: Column | None, order: list[str], save_every: int = K.SAVE_EVERY,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Counts so far after every ``save_every``-th result of a file and its last.

    Without a ``bucket`` the results of a large file are cut by their own order.
    """
    status = F.col("scrape_status")
    sums = {
        "processed": F.lit(1),
        **{s: (status.eqNullSafe(s)).cast("int") for s in ("done", "error", "skipped")},
    }
    run = _running(
        results, ["input_file"], bucket, order, sums, {"processed": "rows_total"}, rows_per_part
    )
    finished = F.col("done") + F.col("error") + F.col("skipped")
    return run.where(
        (F.col("processed") % max(1, save_every) == 0) | (F.col("processed") == F.col("rows_total"))
    ).withColumn("pending", F.greatest(F.lit(0), F.col("rows_total") - finished))


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def busy_time(
    spans: DataFrame, keys: list[str], start: str = "started_at", end: str = "finished_at", rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Microseconds of each key during which at least one of its spans ran, as ``busy``.

    A sweep over starts and ends: a busy period begins where the number of running spans leaves 0 and ends
    where it comes back, so running sums of +1 and -1 tell all. Spans without a start or an end do not
    count, nor do those which end before they start.
    """
    known = spans.select(*keys, _micros(F.col(start)).alias("_from"), _micros(F.col(end)).alias("_to")).where("_to > _from")
    marks = known.select(*keys, F.explode(F.array(
        F.struct(F.col("_from").alias("at"), F.lit(1).alias("step")), F.struct(F.col("_to").alias("at"), F.lit(-1).alias("step")),
    )).alias("m")).groupBy(*keys, F.col("m.at").alias("_at")).agg(F.sum("m.step").alias("_step")).where("_step <> 0")
    run = prefix_sums(marks, keys, ["_at"], {"_depth": F.col("_step")}, rows_per_part=rows_per_part)
    at = F.col("_at").cast("decimal(38,0)")
    turn = F.when(F.col("_depth") == F.col("_step"), -at).when(F.col("_depth") == 0, at)
    return run.groupBy(*keys).agg(F.coalesce(F.sum(turn), F.lit(0)).cast("bigint").alias("busy"))


def run_summary(output: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Report rows of a run: one per file, one of totals, and one per file which could not be used.

    ``output`` holds ``input_file, scrape_status`` and, for the times, ``started_at, finished_at`` of its
    rows; ``failures`` holds ``input_file, message`` (see :func:`sitewise.sources.tables.read_site_files`).
    ``duration_sec`` runs from the first start to the last end, ``busy_sec`` leaves out the time in which
    nothing ran; overlapping rows count once. A file is completed when none of its rows is pending; rows
    without a file are a group which is no file.

    Flat rows rather than one nested document, so that the number of input files is
    not bounded by what fits in a row; :func:`sitewise.sources.sinks.write_summary`
    writes them as JSON lines.
    """
    kind = F.when(F.col("is_total"), "totals").otherwise("file")
    counts = ["rows_total", "rows_done", "rows_error", "rows_skipped", "rows_pending"]
    rolled = status_rollup(output)
    if {"started_at", "finished_at"} <= set(output.columns):
        each = output.select("started_at", "finished_at", F.explode(F.array(
            F.struct(F.lit(False).alias("is_total"), "input_file"), F.struct(F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("input_file")),
        )).alias("k")).select("started_at", "finished_at", "k.is_total", "k.input_file")
        ends = each.groupBy("is_total", "input_file").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
        times = _same_file(ends, busy_time(each, ["is_total", "input_file"]), "left").withColumns({
            "duration_sec": seconds_between(F.col("started_at"), F.col("finished_at")),
            "busy_sec": F.round(F.coalesce("busy", F.lit(0)) / 1_000_000, 3),
        }).drop("busy")
        rolled = _same_file(rolled, times, "left")
    else:
        rolled = rolled.withColumns({
            "started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp"),
            "duration_sec": F.lit(None).cast("double"), "busy_sec": F.lit(None).cast("double"),
        })
    if failures is None:
        failures = output.sparkSession.createDataFrame([], "input_file string, message string")
    file = ~F.col("is_total") & F.col("input_file").isNotNull()
    one, none = F.lit(1), F.lit(0)
    marks = rolled.select(
        F.when(file, one).otherwise(none).alias("total"), F.when(file & (F.col("rows_pending") == 0), one).otherwise(none).alias("completed"),
        none.alias("failed"),
    ).unionByName(failures.select(one.alias("total"), none.alias("completed"), one.alias("failed")))
    files = marks.agg(*(F.sum(c).alias(f"files_{c}") for c in marks.columns)).withColumn("is_total", F.lit(True))
    told = rolled.join(F.broadcast(files), "is_total", "left").select(
        kind.alias("kind"), "input_file", *counts, "started_at", "finished_at", "duration_sec", "busy_sec",
        "files_total", "files_completed", "files_failed",
    )
    bad = failures.select(F.lit("failure").alias("kind"), "input_file", "message")
    return told.withColumn("message", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def _same_file(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({"is_total": "_total", "input_file": "_file"})
    on = (F.col("is_total") == F.col("_total")) & F.col("input_file").eqNullSafe(F.col("_file"))
    return left.join(renamed, on, how).drop("_total", "_file")
