"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as I
from sitewise.functions import html as H
from sitewise.functions import text as X
from sitewise.functions import urls as U
from sitewise.operators import domains, fetches, links, pages, reports, resume, sites
from sitewise.plans.site_output import (
    archive_plan, page_records, planned_content, site_output, site_results,
)
from sitewise.sources import sinks, snapshots, tables
from sitewise.sources.scratch import scratch_dir
from sitewise.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# For the page results alone: no page of the test data is as short as the default of 100.
MIN_PAGE_CHARS = 600


def query(function):
    QUERIES[function.__name__] = function
    return function


# Sources and sinks

@query
def site_list(spark, d):
    path = scratch_dir(spark, "site-list")
    listed = I.sites(spark, d).withColumn(
        "note", F.concat(F.lit('say "hi",\n'), F.col("website"))
    ).drop("ord")
    sinks.export_csv(listed, path)
    return tables.read_site_list(spark, path).select("row_id", "website", "note")


@query
def files_union(spark, d):
    root = scratch_dir(spark, "site-files")
    sheets = I.table(spark, d, "pages").select(
        "page_id", F.floor(F.col("page_id") / 50).alias("sheet"),
        U.netloc(F.col("url")).alias("website"), F.col("url").alias("note"),
    )

    def save(part, folder, *columns):
        (
            part.repartition("sheet").sortWithinPartitions("sheet", "page_id")
            .select("sheet", *columns)
            .write.partitionBy("sheet").options(header="true", escape='"').csv(f"{root}/{folder}")
        )

    save(sheets.where(F.col("sheet") % 3 == 0), "a", "website", "note")
    save(sheets.where(F.col("sheet") % 3 == 1), "b/c", "note", "page_id", "website")
    save(
        sheets.where(F.col("sheet") % 3 == 2).withColumnRenamed("website", "site"), "d", "site", "note"
    )
    sheets.where(F.col("sheet") % 3 == 2).select("note").write.text(f"{root}/e")
    listed, failures = tables.read_site_files(spark, root)
    sheet = F.regexp_extract("input_file", r"sheet=(\d+)", 1).cast("bigint").alias("sheet")
    good = listed.select(
        F.lit("site").alias("kind"), sheet, "ord", "website", "row_id",
        F.col("attributes")["note"].alias("note"),
    )
    bad = failures.select(F.lit("failure").alias("kind"), sheet, F.col("message").alias("note"))
    return good.unionByName(bad, allowMissingColumns=True)


@query
def conform_schema(spark, d):
    sheet = I.sites(spark, d).select("row_id", "website", F.col("website").alias("final_url"))
    return resume.conform(sheet)


@query
def sink_roundtrip(spark, d):
    path = scratch_dir(spark, "sink")
    results = site_results(I.site_fetches(spark, d))
    sinks.write_sites(results, f"{path}/table")
    stored = spark.read.parquet(f"{path}/table")
    sinks.export_csv(stored, f"{path}/copy")
    copy = spark.read.options(**tables.CSV_OPTIONS).csv(f"{path}/copy")
    text = ("error_reason", "website_text_preview", "site_headings", "started_at")
    return stored.select("row_id", "total_bytes", "scrape_status").join(
        copy.select("row_id", *(F.coalesce(c, F.lit("")).alias(c) for c in text)), "row_id"
    )


# URLs

def _page_urls(spark, d):
    return I.table(spark, d, "pages").select("page_id", "url")


@query
def url_normalize(spark, d):
    """Each URL and some altered forms of it."""
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("  "), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("\n")),
        F.concat(F.regexp_replace(F.upper(F.regexp_extract("url", "^[a-z]+://[^/]*", 0)), "^HTTP", "HtTp"), F.lit("?#x")),
        F.lit("   "),
    )
    shown = _page_urls(spark, d).select("page_id", F.posexplode(forms).alias("form", "raw"))
    return shown.select("page_id", "form", U.normalize_url(F.col("raw")).alias("normalized_url"))


@query
def domain_key(spark, d):
    return _page_urls(spark, d).select("page_id", U.domain_key(F.col("url")).alias("domain"))


@query
def domain_key_by_table(spark, d):
    """The same with the suffixes as a table: every last label is a suffix."""
    urls = _page_urls(spark, d)
    suffixes = urls.select(F.regexp_extract(U.netloc(F.col("url")), r"([^.]+)$", 1).alias("suffix")).distinct()
    return domains.with_domain(urls, "url", suffixes).select("page_id", "domain")


@query
def link_resolve(spark, d):
    staged = I.odd_hrefs(spark, d).withColumn("_base", U.url_parts(F.col("base_url")))
    return staged.select(
        "page_id", "pos", U.normalize_url(U.resolve(F.col("_base"), F.col("href"))).alias("url")
    )


@query
def stable_row_id(spark, d):
    value = F.when(F.col("page_id") % 7 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" "), F.upper("url"), F.lit("\t"))
    )
    return _page_urls(spark, d).select(
        "page_id", U.stable_row_id(value, F.col("page_id")).alias("row_id")
    )


# Text and HTML

@query
def clean_text(spark, d):
    noisy = F.replace(
        F.replace(F.col("text"), F.lit(". "), F.lit(". \t ")), F.lit("\n"), F.lit("\n\n\n\n")
    )
    documents = I.table(spark, d, "documents")
    return documents.select("doc_id", X.clean_text(noisy).alias("text"))


def _reduced(spark, d):
    return I.pages(spark, d).select("page_id", H.reduce_html(F.col("html")).alias("reduced"))


def _decluttered(spark, d):
    return _reduced(spark, d).select("page_id", H.declutter(F.col("reduced")).alias("markup"))


@query
def page_full_text(spark, d):
    return _reduced(spark, d).select("page_id", H.full_text(F.col("reduced")).alias("full_text"))


@query
def page_text_declutter(spark, d):
    return _decluttered(spark, d).select("page_id", H.text_lines(F.col("markup")).alias("text"))


@query
def page_main_text(spark, d):
    return _decluttered(spark, d).select(
        "page_id",
        H.main_text(F.col("markup")).alias("main_text"),
        H.paragraph_text(F.col("markup")).alias("paragraph_text"),
    )


@query
def page_densest_block(spark, d):
    """Pages without a marked article, their menus as paragraphs of links."""
    html = F.regexp_replace(F.col("html"), "(?i)</?(?:article|nav)>", "<div>")
    menu = F.regexp_replace(html, r'<li><a href="([^"]*)">([^<]*)</a></li>', '<p><a href="$1">All about $2 and $2</a></p>')
    markup = H.declutter(H.reduce_html(menu))
    return I.pages(spark, d).select("page_id", H.densest_block(markup).alias("text"))


@query
def page_metadata(spark, d):
    return pages.page_content(I.site_fetches(spark, d)).select(
        "page_id", "title", "meta_description", "headings"
    )


@query
def page_description(spark, d):
    """Descriptions, put into the pages in two spellings."""
    page = F.col("page_id")
    tag = F.when(page % 2 == 0, F.concat(
        F.lit('<META content="d &amp; '), page.cast("string"), F.lit('" name="Description">')
    )).otherwise(F.concat(F.lit("<meta name='description' content='d"), page.cast("string"), F.lit("'/>")))
    html = F.replace(F.col("html"), F.lit("<title>"), F.concat(tag, F.lit("<title>")))
    return I.pages(spark, d).select(
        "page_id", H.meta_description(H.reduce_html(html)).alias("meta_description")
    )


@query
def page_headings(spark, d):
    """Headings, with paragraphs turned into h2 and h3 so that there are many."""
    html = F.regexp_replace("html", r"<p>([^<]*)</p>", "<h2>$1</h2><H3 class='x'>The</H3>")
    return I.pages(spark, d).select(
        "page_id", F.to_json(H.headings(H.reduce_html(html))).alias("headings")
    )


@query
def page_links(spark, d):
    return links.page_links(I.pages(spark, d).select("page_id", "html"))


@query
def text_truncate(spark, d):
    text = F.col("text")
    return I.table(spark, d, "documents").select(
        "doc_id",
        X.truncate(text, 500).alias("preview"), X.over_limit(text, 500).alias("truncated_preview"),
        X.truncate(text, 5000).alias("full"), X.over_limit(text, 5000).alias("truncated_full"),
    )


@query
def page_stats(spark, d):
    return pages.page_content(I.site_fetches(spark, d), metadata=False).select(
        "page_id", "has_html", "bytes", "text_len"
    )


# Filters

@query
def html_filter(spark, d):
    return I.site_fetches(spark, d).select(
        "page_id", H.is_html(F.col("status_code"), F.col("content_type")).alias("is_html")
    )


@query
def js_shell(spark, d):
    """Some pages get a shell's mark, some lose their body."""
    page = F.col("page_id")
    html = (
        F.when(page % 11 == 0, "")
        .when(page % 3 == 0, F.replace(F.col("html"), F.lit("<article>"), F.lit('<article ID="root">')))
        .otherwise(F.col("html"))
    )
    staged = I.pages(spark, d).select("page_id", html.alias("html")).withColumn(
        "visible", H.full_text(H.reduce_html(F.col("html")))
    )
    return staged.select("page_id", H.is_js_shell(F.col("html"), F.col("visible")).alias("is_shell"))


@query
def render_queue(spark, d):
    return pages.render_queue(I.site_fetches(spark, d)).select("page_id", "url", "text_len", "reason")


@query
def retry_queue(spark, d):
    return reports.retry_queue(I.fetch_log(spark, d), F.struct("ts", "event_id"))


@query
def pending_sites(spark, d):
    sheet = I.sites(spark, d)
    output = resume.first_per_id(I.earlier_output(spark, d), "saved")
    checkpoint = sheet.where(F.col("ord") % 2 == 0).select("row_id")
    pending = resume.pending_sites(sheet, output).select("row_id", F.lit("pending").alias("kind"))
    stale = resume.stale_checkpoint_ids(checkpoint, output).withColumn("kind", F.lit("stale"))
    return pending.unionByName(stale)


# Pages and sites

@query
def page_results(spark, d):
    content = pages.page_content(I.site_fetches(spark, d), metadata=False)
    records = pages.page_results(
        content.withColumn("is_home", F.col("page_id") % 4 == 0), MIN_PAGE_CHARS
    )
    return records.select("page_id", "url", "ok", "status_code", "method", "bytes", "text_len", "error")


@query
def site_page_cap(spark, d):
    capped = pages.cap_pages(I.fetches(I.table(spark, d, "pages")).drop("html"))
    return capped.select("row_id", "page_id", "pos", "is_home")


@query
def site_rollup(spark, d):
    return site_results(I.site_fetches(spark, d)).select(
        "row_id", "scrape_status", "error_reason", "final_url", "pages_attempted", "pages_scraped",
        "methods_used", "http_statuses", "total_bytes", "total_text_len", "duration_sec",
        "started_at", "finished_at", "visited_urls", "main_text_len", "pages_planned",
    )


@query
def site_text(spark, d):
    records = page_records(I.site_fetches(spark, d))
    combined = sites.combine_texts(records.where("ok"), "row_id", "pos", "url", "main_text")
    return combined.select("row_id", "combined_text", "n_chars", "truncated")


@query
def conversation_text(spark, d):
    """Ordered combine of conversations; the speaker stands for the URL."""
    return sites.combine_texts(
        I.table(spark, d, "conversations"), "conv_id", "turn", "role", "text"
    ).select("conv_id", "combined_text", "n_chars", "truncated")


@query
def site_text_chunks(spark, d):
    """The whole text of each site in pieces."""
    records = page_records(I.site_fetches(spark, d)).where("ok")
    return sites.combine_chunks(records, "row_id", ["pos"], "url", "main_text", 2_000)


@query
def conversation_text_chunks(spark, d):
    return sites.combine_chunks(I.table(spark, d, "conversations"), "conv_id", ["turn"], "role", "text", 500)


def _site_output(spark, d):
    sheet = I.sites(spark, d).withColumn(
        "website", F.when(F.col("ord") % 13 != 5, F.col("website"))
    )
    fetched = I.site_fetches(spark, d)
    return site_output(sheet, fetched)


QUERIES["site_output"] = _site_output


@query
def fetch_merge(spark, d):
    """Plain, repeated and rendered fetches of a page as one record."""
    return fetches.merge_fetches(I.refetches(spark, d)).select(
        "row_id", "url", "page_id", "pos", "final_url", "status_code", "method", "error", "elapsed_sec", "fetched_at",
        "last_fetched_at", "fetch_count", F.length("html").alias("html_chars"),
    )


@query
def site_output_refetched(spark, d):
    """The whole job over pages which were fetched several times."""
    return site_output(I.sites(spark, d), I.refetches(spark, d)).select(
        "row_id", "scrape_status", "error_reason", "final_url", "pages_attempted", "pages_scraped", "methods_used",
        "http_statuses", "total_bytes", "total_text_len", "duration_sec", "started_at", "finished_at", "visited_urls",
    )


@query
def site_output_resumed(spark, d):
    """The whole job over earlier output: finished sites stay as they are."""
    return site_output(I.sites(spark, d), I.refetches(spark, d), I.earlier_output(spark, d)).select(
        "row_id", "website", "scrape_status", "error_reason", "pages_attempted", "total_bytes", "site_title",
    )


# Links and crawl plans

def _homes(spark, d):
    return I.pages(spark, d).select(
        "page_id", U.normalize_url(F.col("url")).alias("final_url"), "html"
    )


@query
def link_candidates(spark, d):
    return links.link_candidates(_homes(spark, d), 12).drop("final_url")


@query
def link_candidates_wide(spark, d):
    return links.link_candidates(_homes(spark, d), 30).drop("final_url")


@query
def sitemap_urls(spark, d):
    found = links.sitemap_urls(I.sitemaps(spark, d))
    return found.select("row_id", "path", F.posexplode("urls").alias("pos", "url"))


def _plan_with_sitemap(spark, d, mode, limit):
    homes = _homes(spark, d).withColumnRenamed("page_id", "row_id").withColumn(
        "row_id", F.col("row_id").cast("string")
    )
    plan = links.plan_with_sitemap(homes, I.sitemaps(spark, d), limit, mode=mode)
    return plan.drop("final_url")


@query
def plan_with_sitemap(spark, d):
    return _plan_with_sitemap(spark, d, "ranked", 12)


@query
def plan_with_sitemap_leftover(spark, d):
    return _plan_with_sitemap(spark, d, "leftover", 30)


@query
def unvisited_links(spark, d):
    plan = links.link_candidates(_homes(spark, d), 12).withColumnRenamed("page_id", "row_id")
    visited = plan.where((F.col("pos") == 0) | (F.col("pos") % 3 == 1)).select("row_id", "url")
    return links.unvisited(plan, visited).select("row_id", "url", "pos")


def _lookup(spark, d, limit):
    """Plans of all pages, looked up among the archived pages."""
    plan = links.link_candidates(_homes(spark, d), limit).select(
        F.col("page_id").alias("from_page"), "pos", "url"
    )
    archive = links.latest_by_url(I.fetches(I.table(spark, d, "pages")).drop("html", "pos"))
    found = archive.select("url", "page_id", "status_code")
    return links.crawl_lookup(plan, found)


@query
def crawl_lookup(spark, d):
    return _lookup(spark, d, 12)


@query
def crawl_lookup_wide(spark, d):
    return _lookup(spark, d, 30)


@query
def archive_crawl(spark, d):
    """From a list of page URLs to the site table, all from the archive."""
    sheet, archive = _page_sites(spark, d), I.site_fetches(spark, d)
    plan = archive_plan(sheet, archive)
    hits = plan.groupBy("row_id").agg(F.count_if("hit").alias("plan_hits"))
    return site_output(sheet, planned_content(plan, archive)).join(hits, "row_id").select(
        "ord", "row_id", "scrape_status", "error_reason", "final_url", "pages_attempted",
        "total_text_len", "visited_urls", "plan_hits",
    )


def _page_sites(spark, d):
    return I.table(spark, d, "pages").select(
        F.col("url").alias("website"), F.col("page_id").alias("ord")
    )


@query
def to_fetch(spark, d):
    """Planned pages of which the archive has no copy; every seventh page is not archived."""
    archive = I.site_fetches(spark, d).where(F.col("page_id") % 7 != 3)
    plan = archive_plan(_page_sites(spark, d), archive)
    return links.to_fetch(plan).select("row_id", "url", "pos")


# Resume

@query
def resume_merge(spark, d):
    sheet = I.sites(spark, d).withColumn(
        "website", F.when(F.col("ord") % 4 != 0, F.col("website"))
    )
    merged = resume.resume_merge(sheet, I.earlier_output(spark, d), "saved")
    return merged.select(
        "row_id", "ord", "website", "scrape_status", "error_reason", "pages_attempted", "site_title",
        "total_bytes",
    )


@query
def resume_cycle(spark, d):
    """The job run twice where its output lies: half of the sites first, then all over the first output."""
    path = scratch_dir(spark, "cycle")
    sheet = I.sites(spark, d)

    def run(fetched):
        earlier = snapshots.read_output(spark, f"{path}/output")
        snapshots.write_version(site_output(sheet, fetched, earlier).drop("ord"), f"{path}/output")
        snapshots.write_done_ids(snapshots.read_output(spark, f"{path}/output"), f"{path}/done")

    half = sheet.where(F.col("ord") % 2 == 0).select("row_id")
    run(I.site_fetches(spark, d).join(half, "row_id", "left_semi"))
    done = snapshots.read_done_ids(spark, f"{path}/done").select("row_id", F.lit(True).alias("done_before"))
    run(I.refetches(spark, d))
    # Two versions are kept, so the checkpoint of the first run can still be read.
    output = snapshots.read_output(spark, f"{path}/output").join(done, "row_id", "left")
    return output.select(
        "row_id", "website", "scrape_status", "error_reason", "pages_attempted", "total_bytes", "visited_urls",
        F.coalesce("done_before", F.lit(False)).alias("done_before"),
    )


@query
def upsert_results(spark, d):
    table = resume.resume_merge(I.sites(spark, d), I.earlier_output(spark, d), "saved")
    fresh = I.sites(spark, d).where(F.col("ord") % 2 == 0).select(
        "row_id", F.lit("done").alias("scrape_status"), F.lit("").alias("error_reason"),
        F.when(F.col("ord") % 4 == 0, F.col("ord").cast("int")).alias("pages_attempted"),
    )
    return resume.upsert_results(table, fresh).select(
        "row_id", "scrape_status", "error_reason", "pages_attempted", "site_title"
    )


# Reports

@query
def site_time_budget(spark, d):
    kept = reports.site_time_budget(I.fetch_log(spark, d), None, ["ts", "event_id"])
    return kept.select("event_id", "row_id", "spent_ms")


@query
def progress_timeline(spark, d):
    return reports.progress_timeline(I.fetch_log(spark, d), None, ["ts", "event_id"]).select(
        "input_file", "event_id", "processed", "done", "error", "skipped", "rows_total", "pending"
    )


@query
def status_counts(spark, d):
    return reports.status_counts(I.fetch_log(spark, d))


@query
def status_rollup(spark, d):
    return reports.status_rollup(I.fetch_log(spark, d))


@query
def failure_sample(spark, d):
    failed = I.fetch_log(spark, d).where(F.col("scrape_status") == "error").withColumn(
        "message", F.concat(F.col("row_id"), F.lit(": event "), F.col("event_id").cast("string"))
    )
    return reports.failure_sample(failed, ["ts", "event_id"])


@query
def run_summary(spark, d):
    path = scratch_dir(spark, "summary")
    log = I.fetch_log(spark, d).withColumn("started_at", F.col("ts"))
    log = log.withColumn("finished_at", F.timestamp_add("MILLISECOND", X.to_millis(F.col("elapsed_sec")), F.col("ts")))
    sheets = I.table(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("sheet")).where("sheet % 3 = 2").distinct()
    failures = sheets.select(F.concat(F.lit("list"), F.col("sheet").cast("string")).alias("input_file"), F.lit("no website column").alias("message"))
    summary = reports.run_summary(log, failures)
    sinks.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


# Streaming

@query
def incremental_sites(spark, d):
    """Pages arrive in batches; the end state equals the batch job's."""
    work = scratch_dir(spark, "incremental")
    source = I.table(spark, d, "pages").withColumn("part", F.pmod("page_id", F.lit(3)))
    schema = source.drop("part").schema
    source.repartition("part").write.partitionBy("part").parquet(f"{work}/source")
    incremental.run_incremental_sites(
        spark, f"{work}/source/part=*", schema, f"{work}/state",
        to_fetches=I.fetches, max_files_per_trigger=2,
    )
    return incremental.current_results(spark, f"{work}/state").select(
        "row_id", "scrape_status", "pages_attempted", "pages_scraped", "total_bytes",
        "total_text_len", "visited_urls", "site_title",
    )


@query
def incremental_refetched(spark, d):
    """Pages fetched several times, over batches; the end state equals the batch job's."""
    work = scratch_dir(spark, "incremental")
    source = I.refetches(spark, d).withColumn("part", F.pmod(F.hour("fetched_at") + F.col("page_id"), F.lit(6)))
    schema = source.drop("part").schema
    source.repartition("part").write.partitionBy("part").parquet(f"{work}/source")
    incremental.run_incremental_sites(spark, f"{work}/source/part=*", schema, f"{work}/state", slices=4, max_files_per_trigger=1)
    return incremental.current_results(spark, f"{work}/state").select(
        "row_id", "scrape_status", "error_reason", "pages_attempted", "http_statuses", "total_text_len", "duration_sec", "visited_urls",
    )


@query
def live_status_latest(spark, d):
    """Counts by status of each site's latest result, as results arrive in no order."""
    work = scratch_dir(spark, "live")
    results = I.fetch_log(spark, d).select("row_id", "input_file", "scrape_status", "ts", "event_id")
    results.repartition(5, "event_id").write.parquet(f"{work}/source")
    incremental.run_live_status(
        spark, f"{work}/source", results.schema, work, order=("ts", "event_id"), slices=4, max_files_per_trigger=1,
    )
    return incremental.live_status(spark, work)


@query
def live_status(spark, d):
    work = scratch_dir(spark, "live")
    results = I.fetch_log(spark, d).select("input_file", "scrape_status")
    results.write.parquet(f"{work}/source")
    incremental.run_live_status(spark, f"{work}/source", results.schema, work)
    return incremental.live_status(spark, work)
