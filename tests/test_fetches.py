import datetime as dt

from pyspark.sql import functions as F

from sitewise import schema as S
from sitewise.operators import links, resume
from sitewise.operators.bloom import may_match
from sitewise.operators.fetches import identified, merge_fetches, merged_states, page_states
from sitewise.plans.site_output import archive_plan, crawl_from_archive, planned_content, site_output, site_results
from tests.fixtures import LONG, T0, page
from tests.test_plans import plan


def seen(url, n, html, status=200, method="requests", error="", pos=0, site="s"):
    kind = None if method == "playwright" else "text/html"
    return (site, url, "", pos, status, kind, method, html, error, 1.0, T0 + dt.timedelta(minutes=n))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), S.FETCHES)


def merged(spark, *rows):
    return {r.url: r for r in merge_fetches(table(spark, *rows)).collect()}


def test_which_fetch_stands(spark):
    got = merged(
        spark,
        seen("retried", 0, "", 503, error="HTTP 503"), seen("retried", 1, "ok"), seen("retried", 2, "", 500),
        seen("rendered", 0, "plain"), seen("rendered", 1, "browser", None, "playwright"), seen("rendered", 2, "plain again"),
        seen("blocked", 0, "no", 403, error="blocked"), seen("blocked", 1, "", None, "playwright", "timeout"),
        seen("short", 0, "short"), seen("short", 1, "", None, "playwright", "timeout"),
        seen("twice", 0, "same"), seen("twice", 0, "same"),
        seen("once", 0, None, 404, error=None), seen(None, 0, "x"), seen(None, 1, "y"),
        seen("two renders", 0, "a", None, "playwright"), seen("two renders", 1, "", None, "playwright", "crash"),
    )
    at = {u: (r.html, r.status_code, r.method, r.error, r.fetch_count) for u, r in got.items()}
    assert at["retried"] == ("ok", 200, "requests", "", 3)
    assert at["rendered"] == ("browser", 200, "playwright", "", 3)
    assert at["blocked"][1:] == (403, "playwright", "blocked timeout", 2)
    assert at["short"] == ("short", 200, "requests", "timeout", 2)
    assert at["twice"] == ("same", 200, "requests", "", 2) and at["once"] == (None, 404, "requests", "", 1)
    assert at[None] == ("y", 200, "requests", "", 2)
    assert at["two renders"] == ("a", None, "playwright", "crash", 2)
    assert got["retried"].elapsed_sec == 3.0 and got["retried"].fetched_at == T0
    assert got["retried"].last_fetched_at == T0 + dt.timedelta(minutes=2)


def test_states_merge_in_any_grouping(spark):
    rows = [seen(f"u{i % 7}", i, "x" * (i % 3), 200 + 100 * (i % 4), "playwright" if i % 5 == 0 else "requests", f"e{i % 2}", i % 11) for i in range(80)]
    states = page_states(identified(table(spark, *rows)))
    whole = merged_states(states)
    halves = merged_states(states.where(F.col("pos") % 2 == 0)).unionByName(merged_states(states.where(F.col("pos") % 2 == 1)))
    assert sorted(map(str, merged_states(halves).collect())) == sorted(map(str, whole.collect()))


def test_a_refetched_page_counts_once(spark):
    rows = [seen("u0", 0, "", 503, error="HTTP 503"), seen("u0", 5, page(LONG)), seen("u1", 1, page(LONG), pos=1), seen("u1", 9, page(LONG + "new"), pos=1)]
    sheet = spark.createDataFrame([("s.org", 0, "s")], "website string, ord long, row_id string")
    got = site_output(sheet, table(spark, *rows)).first()
    assert (got.pages_attempted, got.pages_scraped, got.visited_urls) == (2, 2, "u0;u1")
    assert got.website_text_full.count("new") == 1 and got.http_statuses == "200;200" and got.duration_sec == 540.0


def test_merged_equals_plain_without_refetches(spark):
    rows = [seen(f"u{i}", i, page(f"{i} {LONG}") if i % 4 else "", 200 if i % 4 else 404, pos=i, site=f"s{i % 3}") for i in range(60)]
    data = table(spark, *rows)
    plain, once = site_results(data), site_results(data, merge=True)
    assert sorted(map(str, once.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_hot_site_and_finished_sites_are_pruned_in_the_scan(spark, tmp_path):
    rows = [seen(f"u{i}", i, page(LONG), pos=i, site="hot") for i in range(900)] + [seen("v", 0, page(LONG), site="done")]
    table(spark, *rows).repartition(3).write.parquet(f"{tmp_path}/f")
    fetched = spark.read.parquet(f"{tmp_path}/f")
    done = spark.createDataFrame([("done",)], "row_id string")
    out = site_results(fetched, merge=True, done=done)
    text = plan(out)
    # The filter stands below text extraction, and HTML is in no exchange.
    assert text.rindex("regexp_replace") < text.index("_words")
    lines = text.splitlines()
    fed = [below for line, below in zip(lines, lines[1:]) if " Exchange " in line]
    assert len(fed) > 2 and all(" html#" not in below and "[html#" not in below for below in fed)
    assert "EvalPython" not in text
    assert [(r.row_id, r.pages_attempted) for r in out.collect()] == [("hot", 12)]


def test_filter_keeps_every_match_and_drops_most_others(spark):
    keys = spark.range(5000).select((F.col("id") * 3).cast("string").alias("k"), F.when(F.col("id") % 2 == 0, 1).alias("n"))
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 6 == 0, 1).alias("n"))
    left = may_match(rows, keys, ["k", "n"])
    found = left.join(keys, (rows.k == keys.k) & rows.n.eqNullSafe(keys.n), "left_semi").count()
    exact = rows.join(keys, (rows.k == keys.k) & rows.n.eqNullSafe(keys.n), "left_semi").count()
    assert found == exact == 5000 and left.count() < 9000
    assert may_match(rows, keys.limit(0), ["k", "n"]).count() == 0
    assert may_match(rows, keys, ["k", "n"], max_bytes=10) is rows


def archive(spark, *rows):
    full = [(*seen(u, n, h), i) for i, (u, n, h) in enumerate(rows)]
    return spark.createDataFrame(full, "row_id string, url string, final_url string, pos long, status_code int, content_type string, method string, html string, error string, elapsed_sec double, fetched_at timestamp_ntz, page_id long")


def test_plan_hits_and_pages_to_fetch(spark):
    home = page('<a href="/products">p</a><a href="/team">t</a>' + LONG)
    old = page('<a href="/old">o</a>')
    known = archive(spark, ("https://a.org/", 0, old), ("https://a.org/", 9, home), ("https://a.org/team", 0, page(LONG)), ("https://c.org/", 0, page(LONG)))
    sheet = spark.createDataFrame([("a.org", 0), ("b.org", 1), ("", 2)], "website string, ord long")
    found = archive_plan(sheet, known, max_pages=30)
    rows = sorted((r.pos, r.url, r.hit) for r in found.collect())
    assert rows[0] == (0, "https://a.org/", True) and rows[1] == (0, "https://b.org/", False)
    assert {(u, h) for _, u, h in rows[2:]} >= {("https://a.org/products", False), ("https://a.org/team", True), ("https://a.org/faq", False)}
    assert not any("old" in u for _, u, _ in rows)
    missing = {r.url for r in links.to_fetch(found).collect()}
    assert "https://b.org/" in missing and "https://a.org/products" in missing and "https://a.org/team" not in missing
    content = {r.url: r.has_html for r in crawl_from_archive(sheet, known, max_pages=30).collect()}
    assert content == {"https://a.org/": True, "https://a.org/team": True}
    text = plan(planned_content(found, known))
    assert text.rindex("regexp_replace") < text.index("_words")


def test_pending_sites_by_snapshot(spark, tmp_path):
    from sitewise.sources import snapshots

    path = str(tmp_path / "out")
    assert snapshots.read_output(spark, path).count() == 0 and snapshots.versions(spark, path) == []
    sheet = spark.createDataFrame([("a.org", 0, "a"), ("b.org", 1, "b")], "website string, ord long, row_id string")
    fetched = [seen("https://a.org/", 0, page(LONG), site="a"), seen("https://b.org/", 0, "", 503, site="b")]
    for n, rows in enumerate((fetched, [seen("https://b.org/", 5, page(LONG), site="b")], [])):
        earlier = snapshots.read_output(spark, path)
        snapshots.write_version(site_output(sheet, table(spark, *rows), earlier), path)
        snapshots.write_done_ids(snapshots.read_output(spark, path), str(tmp_path / "done"))
        done = [r.row_id for r in snapshots.read_done_ids(spark, str(tmp_path / "done")).collect()]
        assert done == (["a"] if n == 0 else ["a", "b"])
        assert resume.pending_sites(sheet, snapshots.read_output(spark, path)).count() == (1 if n == 0 else 0)
    assert snapshots.versions(spark, path) == [2, 3]


def test_a_writer_stopped_half_way_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from sitewise.sources import snapshots

    path = str(tmp_path / "t")
    snapshots.write_version(spark.range(5), path)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        try:
            snapshots.write_version(spark.range(9), path)
        except RuntimeError:
            pass
    assert snapshots.read_version(spark, path).count() == 5
    assert snapshots.write_version(snapshots.read_version(spark, path).where("id < 3"), path) == 2
    assert snapshots.read_version(spark, path).count() == 3 and snapshots.read_version(spark, path, 1).count() == 5
