"""Small tables with hand-worked results."""

from datetime import datetime, timedelta

from sitewise.schema import FETCHES

T0 = datetime(2024, 1, 1)
LONG = "word " * 60


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


def fetch(row_id, url, pos, html, status=200, kind="text/html", method="requests", error="",
          elapsed=1.0, final_url=""):
    at = T0 + timedelta(seconds=10 * pos)
    return (row_id, url, final_url, pos, status, kind, method, html, error, elapsed, at)


def fetch_table(spark, rows):
    return spark.createDataFrame(rows, FETCHES)
