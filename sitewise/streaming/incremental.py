"""Incremental site results: new pages in, touched sites out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise import constants as K
from sitewise.operators import fetches as merging
from sitewise.operators.pages import cap_pages, first_pages, page_content, within_budget
from sitewise.operators.reports import status_counts
from sitewise.operators.sites import roll_up
from sitewise.plans.site_output import checked
from sitewise.sources.snapshots import names_in, remove
from sitewise.streaming.store import RunStore

# State is kept by slice of row_id, so that a batch reads back only the slices of the sites which it
# touched.
SLICES = 64
#: Tasks which take out the text of a batch, for each core.
TASKS_PER_CORE = 3


def _replace_batch(table: DataFrame, path: str, batch_id: int, *by: str) -> None:
    """Write one batch; a replayed batch replaces itself and nothing else."""
    (
        table.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *by)
        .parquet(path)
    )


def _dealt_out(batch: DataFrame) -> DataFrame:
    """The batch over all cores. Its few files may have a row group or two each, which no reader splits, and
    taking out text costs far more than moving a page once."""
    return batch.repartition(TASKS_PER_CORE * batch.sparkSession.sparkContext.defaultParallelism)


def run_incremental_sites(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    work: str,
    to_fetches=lambda df: df,
    slices: int = SLICES,
    max_files_per_trigger: int | None = None,
    max_pages: int = K.MAX_PAGES,
    **limits: float,
) -> None:
    """Process what is new under ``source`` and stop; call again for more.

    Each batch merges its pages with what is kept of the sites it touches (see
    :mod:`sitewise.operators.fetches`) and writes new results for these sites, so the end state is that
    of one job over all fetches, with several fetches of a page as one. Kept are the first ``max_pages``
    pages of a site by position, as no others can count; a page has one position, so a later fetch of it
    comes with the same. Rerunning on the same checkpoint does nothing; replaying a batch gives the same
    rows again.
    """
    state, results = site_stores(spark, work, slices)

    def apply(batch: DataFrame, batch_id: int) -> None:
        incoming = f"{work}/incoming"
        merging.identified(page_content(to_fetches(_dealt_out(batch)))).write.mode("overwrite").parquet(incoming)
        content = spark.read.parquet(incoming)
        touched = content.select("row_id").distinct()
        kept = merging.carry_on(state.read(batch_id, touched), content, lambda pages: first_pages(pages, max_pages))
        records = merging.kept_records(state.commit(batch_id, kept))
        results.commit(batch_id, _rolled(records, max_pages, **limits))

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _rolled(
    records: DataFrame, max_pages: int, time_budget_sec: float = K.TIME_BUDGET_SEC, page_delay_sec: float = K.PAGE_DELAY_SEC,
    min_page_chars: int = K.MIN_PAGE_CHARS, **texts: int,
) -> DataFrame:
    capped = within_budget(cap_pages(records, max_pages), time_budget_sec, page_delay_sec)
    return roll_up(checked(capped, min_page_chars), max_pages, **texts)


def site_stores(spark: SparkSession, work: str, slices: int = SLICES) -> tuple[RunStore, RunStore]:
    """What is kept of the pages of every site, and the results."""
    return RunStore(spark, f"{work}/content", slices=slices), RunStore(spark, f"{work}/results", slices=slices)


def current_results(spark: SparkSession, work: str) -> DataFrame:
    """The newest result of every site."""
    found = site_stores(spark, work)[1].read()
    if found is None:
        raise ValueError("no results were written yet")
    return found


def run_live_status(
    spark: SparkSession, source: str, schema: T.StructType, work: str, to_output=lambda df: df,
    order: Sequence[str] = (), slices: int = SLICES, max_files_per_trigger: int | None = None,
) -> None:
    """Keep counts by status up to date while results arrive; call again for more.

    Results with a ``row_id`` replace the earlier result of the site: its old status leaves the counts
    as the new one enters. ``order`` names columns by which a result is later than another (results of
    one batch which tie go by status); without it, or at a tie between batches, the later batch counts.
    Results without a ``row_id`` all count.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    results = to_output(reader.parquet(source))
    if "row_id" in results.columns:
        latest = RunStore(spark, f"{work}/latest", slices=slices)
        counted, mode = results, "append"

        def publish(batch: DataFrame, batch_id: int) -> None:
            changes = latest.commit(batch_id, _changes(batch, batch_id, latest, tuple(order), work))
            _publish_counts(spark, changes, batch_id, f"{work}/counts")
    else:
        counted, mode = status_counts(results), "complete"

        def publish(batch: DataFrame, batch_id: int) -> None:
            _replace_batch(batch, f"{work}/counts", batch_id)

    query = (
        counted.writeStream.outputMode(mode)
        .foreachBatch(publish)
        .option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _changes(batch: DataFrame, batch_id: int, latest: RunStore, order: tuple[str, ...], work: str) -> DataFrame:
    """Sites of a batch whose latest result it has, with that result and the one before."""
    result = F.struct(F.struct(F.lit(0).alias("none"), *order).alias("at"), "scrape_status", "input_file")
    batch.groupBy("row_id").agg(F.max(result).alias("now")).write.mode("overwrite").parquet(f"{work}/incoming")
    fresh = batch.sparkSession.read.parquet(f"{work}/incoming")
    old = latest.read(batch_id, fresh.select("row_id"))
    if old is None:
        return fresh.withColumn("was", F.lit(None).cast(fresh.schema["now"].dataType))
    both = fresh.join(old.select("row_id", F.col("now").alias("was")), "row_id", "left")
    return both.where(F.col("was").isNull() | (F.col("now.at") >= F.col("was.at")))


_COUNTS = ("rows_total", "rows_done", "rows_error", "rows_skipped")


def _publish_counts(spark: SparkSession, changes: DataFrame, batch_id: int, path: str) -> None:
    """The counts of the batch before, less the results replaced, plus the new ones."""
    def counted(which: str, n: int) -> DataFrame:
        status = F.col(f"{which}.scrape_status")
        return changes.where(F.col(which).isNotNull()).select(
            F.col(f"{which}.input_file").alias("input_file"), F.lit(n).cast("bigint").alias("rows_total"),
            *(F.when(status == s, n).otherwise(0).cast("bigint").alias(f"rows_{s}") for s in ("done", "error", "skipped")),
        )

    moved = counted("was", -1).unionByName(counted("now", 1))
    known = sorted(int(n.split("=")[1]) for n in names_in(spark, path) if n.startswith("batch_id="))
    before = [b for b in known if b < batch_id]
    if before:
        moved = moved.unionByName(spark.read.parquet(f"{path}/batch_id={before[-1]}").select(*moved.columns))
    sums = moved.groupBy("input_file").agg(*(F.sum(c).alias(c) for c in _COUNTS)).where(F.col("rows_total") > 0)
    _replace_batch(sums.coalesce(1), path, batch_id)
    for old in before[:-1]:
        remove(spark, f"{path}/batch_id={old}")


def live_status(spark: SparkSession, work: str) -> DataFrame:
    """The latest published counts."""
    try:
        counts = spark.read.parquet(f"{work}/counts")
    except AnalysisException as missing:
        raise ValueError("no counts were published yet") from missing
    latest = counts.agg(F.max("batch_id").alias("batch_id"))
    return counts.join(F.broadcast(latest), "batch_id").drop("batch_id")
