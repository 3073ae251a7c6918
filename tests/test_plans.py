import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    """Names of the columns below each exchange, as the plan shows them."""
    lines = text.splitlines()
    found = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange (hash|range|Round|Single)", line):
            below = next((x for x in lines[i + 1:] if "Project [" in x or "FileScan" in x), "")
            found.append((line, below))
    return found


@pytest.fixture(scope="module")
def site_plan(spark):
    from catalog import inputs as I
    from sitewise.plans.site_output import site_results

    fetches = I.fetches(spark.read.parquet(f"{SF}/pages.parquet"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    return plan(site_results(fetches))


def test_site_results_use_one_exchange(site_plan):
    assert len(exchanges(site_plan)) == 1
    assert site_plan.count("WindowGroupLimit") == 2
    assert "BatchEvalPython" not in site_plan and "ArrowEvalPython" not in site_plan


def test_html_stays_out_of_the_exchange(site_plan):
    (line, _), = exchanges(site_plan)
    after = site_plan[: site_plan.index(line)]
    assert "html#" not in after.replace("has_html#", "")


def test_link_planning_has_no_exchange(spark):
    from sitewise.functions.urls import normalize_url
    from sitewise.operators import links
    from pyspark.sql import functions as F

    homes = spark.read.parquet(f"{SF}/pages.parquet").select(
        "page_id", normalize_url(F.col("url")).alias("final_url"), "html"
    )
    text = plan(links.link_candidates(homes, 12))
    assert exchanges(text) == []
    assert text.count("regexp_extract_all") == 2        # anchors, and their attributes: once each


def test_costly_columns_are_worked_out_once(spark):
    text = plan(entry.queries()["render_queue"](spark, SF))
    filters = [x for x in text.splitlines() if re.search(r"[+:]- \(?\d*\)? ?Filter", x) or " Filter " in x[:60]]
    assert filters and all("regexp_replace" not in x for x in filters)


def test_no_query_runs_python_workers(spark):
    for name in ("page_main_text", "plan_with_sitemap", "crawl_lookup", "progress_timeline", "site_output"):
        assert "EvalPython" not in plan(entry.queries()[name](spark, SF)), name


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert set(entry.QUERIES) == set(entry.ORACLE) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_scan_reads_needed_columns_only(spark):
    text = plan(entry.queries()["site_page_cap"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text
