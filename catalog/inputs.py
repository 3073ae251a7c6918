"""Test tables in the engine's terms.

The test data has pages and events but no crawl, so a few columns are stand-ins
worked out from ids.  :mod:`catalog.oracle` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.urls import netloc, normalize_url, stable_row_id

START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def fetches(source: DataFrame) -> DataFrame:
    """A fetch for each page: site = host, order = page_id."""
    page = F.col("page_id")
    host = netloc(F.col("url"))
    url = normalize_url(F.col("url"))
    return source.select(
        stable_row_id(host, page).alias("row_id"),
        url.alias("url"),
        F.when(page % 2 == 0, F.regexp_replace(url, "^http:", "https:")).otherwise("").alias("final_url"),
        page.alias("pos"),
        page.alias("page_id"),
        F.when(page % 23 == 7, 404).when(page % 31 == 5, 503).otherwise(200).alias("status_code"),
        F.when(page % 29 == 11, "application/pdf").when(page % 3 == 0, "")
        .otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(page % 5 == 0, "playwright").otherwise("requests").alias("method"),
        "html",
        F.lit("").alias("error"),
        ((page % 17) * 0.5).alias("elapsed_sec"),
        F.timestamp_add(
            "SECOND", page.cast("int"), F.lit(START).cast("timestamp_ntz")
        ).alias("fetched_at"),
    )


def site_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches(pages(spark, sf_dir))


def refetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched up to three times: plainly, plainly again, and by a browser.

    Every fourth page is blocked at first, some browsers fail, and some fetches are logged twice.
    """
    page, n = F.col("page_id"), F.col("n")
    blocked, failed = (n == 0) & (page % 4 == 0), (n == 2) & (page % 6 != 0)
    tries = F.filter(
        F.array(*map(F.lit, (0, 1, 2))),
        lambda i: (i == 0) | ((i == 1) & (page % 4 < 2)) | ((i == 2) & (page % 3 == 0)),
    )
    logged = F.flatten(F.transform(tries, lambda i: F.array_repeat(i, F.when((i == 0) & (page % 10 == 7), 2).otherwise(1))))
    marks = F.when(n == 1, "<p>again</p>").when(n == 2, "<p>rendered</p>").otherwise("")
    fetched = site_fetches(spark, sf_dir).withColumn("n", F.explode(logged))
    return fetched.withColumns({
        "final_url": F.when(n == 0, F.col("final_url")).otherwise(""),
        "status_code": F.when(blocked, 503).when((n == 1) & (page % 8 == 1), 500).when(n == 1, 200).when(n == 0, F.col("status_code")),
        "content_type": F.when(n == 0, F.col("content_type")).otherwise("text/html"),
        "method": F.when(n == 2, "playwright").otherwise("requests"),
        "html": F.when(blocked | failed, "").otherwise(F.concat("html", marks)),
        "error": F.when(blocked, "blocked").when(failed, "render timeout").otherwise(""),
        "elapsed_sec": F.col("elapsed_sec") + n,
        "fetched_at": F.timestamp_add("HOUR", n, F.col("fetched_at")),
    }).drop("n")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site list of the hosts; ``ord`` is the host's first page."""
    host = netloc(F.col("url"))
    return (
        table(spark, sf_dir, "pages")
        .groupBy(host.alias("website"))
        .agg(F.min("page_id").alias("ord"))
        .withColumn("row_id", stable_row_id(F.col("website"), F.col("ord")))
    )


def ends_in_digit() -> Column:
    return F.col("row_id").rlike("[0-9]$")


def earlier_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results for two thirds of the sites, each in two copies."""
    known = sites(spark, sf_dir).where(F.col("ord") % 3 != 0)
    copies = known.select("row_id", "website", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    done = ends_in_digit() & (F.col("copy") == 1)
    return copies.select(
        "row_id",
        F.concat(F.lit("old."), F.col("website")).alias("website"),
        F.col("copy").alias("saved"),
        F.when(done, "done").otherwise("error").alias("scrape_status"),
        F.when(done, "").otherwise("no_text_extracted").alias("error_reason"),
        (F.length("website") * F.col("copy")).alias("pages_attempted"),
        F.upper("website").alias("site_title"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of fetches: site = user."""
    user, kind = F.col("user_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("user_"), user.cast("string")).alias("row_id"),
        F.concat(
            F.lit("https://u"), user.cast("string"), F.lit(".example.com/"),
            F.get_json_object("props", "$.k"),
        ).alias("url"),
        F.when(kind == "error", 503).when(kind == "signup", 404).otherwise(200).alias("status_code"),
        F.when(kind == "view", "playwright").otherwise("requests").alias("method"),
        (F.col("value") / 10).alias("elapsed_sec"),
        F.when(user % 5 != 4, F.concat(F.lit("f"), (user % 5).cast("string"))).alias("input_file"),
        F.when(kind == "error", "error").when(kind == "signup", "skipped")
        .when(kind != "view", "done").alias("scrape_status"),
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sitemap files for each page, built from its nav links.

    The first file is missing on every third page.  The links' names get keyword
    paths and depths in turn, so that scores differ.
    """
    from sitewise.functions.html import hrefs, reduce_html

    page = F.col("page_id")
    url = normalize_url(F.col("url"))
    origin = F.regexp_extract(url, "^[a-z]+://[^/?]*", 0)
    places = ("", "/services", "/a/b", "/help/faq", "/products", "")
    staged = pages(spark, sf_dir).withColumn("_links", hrefs(reduce_html(F.col("html"))))
    locations = F.transform("_links", lambda h, i: F.concat(
        F.lit("<url><loc> "), origin, F.get(F.array(*map(F.lit, places)), i % len(places)),
        h, F.lit(" </loc></url>"),
    ))
    body = F.concat(
        F.lit("<urlset>"), F.array_join(locations, "\n"),
        F.lit("<url><LOC>https://other.org/help</LOC></url></urlset>"),
    )
    files = F.array(
        F.struct(
            F.lit("/sitemap.xml").alias("path"),
            F.when(page % 3 == 0, 404).otherwise(200).alias("status_code"),
            body.alias("xml"),
        ),
        F.struct(
            F.lit("/sitemap_index.xml").alias("path"),
            F.lit(200).alias("status_code"),
            F.replace(body, F.lit("<loc> "), F.lit("<loc>\n")).alias("xml"),
        ),
    )
    return staged.select(
        page.cast("string").alias("row_id"), url.alias("base_url"), F.explode(files).alias("_file")
    ).select("row_id", "base_url", "_file.*")


def odd_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nav links of each page rewritten into the other forms an href can take."""
    from sitewise.operators.links import page_links

    name = F.regexp_replace("href", "^/", "")
    forms = (
        F.col("href"), name, F.concat(F.lit("../"), name), F.concat(F.lit("?q="), name),
        F.concat(F.lit("//cdn.example.org/"), name), F.concat(F.lit("./x/../"), name, F.lit("#f")),
    )
    links = page_links(pages(spark, sf_dir).select(
        "page_id", normalize_url(F.col("url")).alias("base_url"), "html"
    ))
    return links.withColumn(
        "href", F.get(F.array(*forms), (F.col("pos") + F.col("page_id")).cast("int") % len(forms))
    )
