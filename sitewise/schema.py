"""Table schemas, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

FETCHES = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_sec", T.DoubleType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])

SITE_OUTPUT = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("scrape_status", T.StringType()),
    T.StructField("error_reason", T.StringType()),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("pages_attempted", T.IntegerType()),
    T.StructField("pages_scraped", T.IntegerType()),
    T.StructField("methods_used", T.StringType()),
    T.StructField("http_statuses", T.StringType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("total_text_len", T.LongType()),
    T.StructField("truncated_full", T.BooleanType()),
    T.StructField("truncated_preview", T.BooleanType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("visited_urls", T.StringType()),
    T.StructField("website_text_full", T.StringType()),
    T.StructField("website_text_preview", T.StringType()),
    T.StructField("website_text_main", T.StringType()),
    T.StructField("site_title", T.StringType()),
    T.StructField("site_meta_description", T.StringType()),
    T.StructField("site_headings", T.StringType()),
    T.StructField("main_text_len", T.IntegerType()),
    T.StructField("pages_planned", T.IntegerType()),
])

# Text columns which start out as '' rather than null.
EMPTY_TEXT_COLUMNS = (
    "scrape_status", "error_reason", "normalized_url", "final_url", "methods_used",
    "http_statuses", "visited_urls",
)
