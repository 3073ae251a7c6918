"""The job run again over its own earlier output."""

import datetime as dt

from pyspark.sql import functions as F

from sitewise import schema as S
from sitewise.operators import links, pages, resume
from sitewise.plans.site_output import site_output
from sitewise.sources import sinks, tables

TEXT = "<html><body><p>" + "Some words of a page. " * 20 + "</p></body></html>"


def fetches(spark, *rows):
    at = dt.datetime(2024, 1, 1)
    full = [(i, u, "", n, s, "text/html", m, h, "", 1.0, at) for i, u, n, s, m, h in rows]
    return spark.createDataFrame(full, S.FETCHES)


def sheet(spark):
    return spark.createDataFrame([("a.org", 0, "s1"), ("b.org", 1, "s2"), ("", 2, "s3")], "website string, ord long, row_id string")


def test_first_run_without_earlier_output_then_resume(spark, tmp_path):
    got = fetches(spark, ("s1", "https://a.org/", 0, 200, "requests", TEXT), ("s2", "https://b.org/", 0, 503, "requests", ""))
    path = str(tmp_path / "out.csv")
    first = site_output(sheet(spark), got, tables.read_earlier_output(spark, path))
    rows = {r.row_id: r for r in first.collect()}
    assert rows["s1"].scrape_status == "done" and rows["s2"].scrape_status == "error"
    assert (rows["s3"].scrape_status, rows["s3"].pages_attempted, rows["s3"].truncated_full) == ("skipped", 0, False)
    sinks.export_csv(first.drop("ord"), path)
    sinks.write_checkpoint(first, str(tmp_path / "ids"))
    again = fetches(spark, ("s1", "https://a.org/", 0, 503, "requests", ""), ("s2", "https://b.org/", 0, 200, "requests", TEXT))
    second = {r.row_id: r for r in site_output(sheet(spark), again, tables.read_earlier_output(spark, path)).collect()}
    assert second["s1"].scrape_status == "done" and second["s1"].pages_scraped == rows["s1"].pages_scraped
    assert second["s2"].scrape_status == "done"
    assert [r.row_id for r in spark.read.parquet(str(tmp_path / "ids")).collect()] == ["s1"]


def test_order_of_earlier_rows_is_a_number(spark):
    old = spark.createDataFrame([("s1", "10", "late"), ("s1", "9", "early")], "row_id string, ord string, scrape_status string")
    assert resume.first_per_id(old, "ord").first().scrape_status == "early"
    assert resume.first_per_id(old.drop("ord").withColumn("scrape_status", F.when(F.col("scrape_status") == "late", "done").otherwise("error"))).first().scrape_status == "done"


def test_rendered_page_stands_and_leaves_the_queue(spark):
    got = fetches(spark, ("s1", "https://a.org/", 0, 403, "playwright", TEXT), ("s2", "https://b.org/", 0, 403, "requests", TEXT))
    assert {r.row_id: r.has_html for r in pages.page_content(got).collect()} == {"s1": True, "s2": False}
    assert [r.row_id for r in pages.render_queue(got).collect()] == ["s2"]


def test_unknown_sitemap_path_is_left_out(spark):
    xml = "<urlset><url><loc>https://a.org/x</loc></url></urlset>"
    known = [("s1", "https://a.org/", p, 200, xml) for p in ("/other.xml", "/sitemap_index.xml")]
    table = spark.createDataFrame(known, "row_id string, base_url string, path string, status_code int, xml string")
    assert [r.path for r in links.sitemap_urls(table).collect()] == ["/sitemap_index.xml"]
