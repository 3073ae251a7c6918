from pyspark.sql import functions as F

from sitewise.operators import pages, resume, sites
from sitewise.plans.site_output import crawl_from_archive, page_records, site_output, site_results
from tests.fixtures import LONG, T0, fetch, fetch_table, page


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_page_ok_rules(spark):
    table = fetch_table(spark, [
        fetch("a", "u0", 0, page("x")),
        fetch("a", "u1", 1, page("y" * 99)),      # with the title's line 101 characters
        fetch("a", "u2", 2, page("y" * 98)),
        fetch("a", "u3", 3, "gone", status=404),
        fetch("a", "u4", 4, None, status=None, error="timeout"),
        fetch("a", "u5", 5, page("z" * 200), kind="application/pdf"),
        fetch("b", "u6", 0, page("").replace("<title>T</title>", "")),
    ])
    got = rows(page_records(table, time_budget_sec=0), "url", "ok", "error")
    assert got == [
        ("u0", True, ""), ("u1", True, ""), ("u2", False, "empty_or_too_short"),
        ("u3", False, "HTTP 404"), ("u4", False, "timeout"), ("u5", False, "HTTP 200"),
        ("u6", False, "empty_text"),
    ]


def test_page_limit_and_time_budget(spark):
    table = fetch_table(spark, [
        fetch("a", f"u{i}", 10 * i, page(LONG), elapsed=e) for i, e in enumerate([20.0, 20.0, 10.0, 5.0])
    ])
    assert [r[0] for r in rows(page_records(table, max_pages=2), "url")] == ["u0", "u1"]
    kept = page_records(table, time_budget_sec=45, page_delay_sec=0)
    assert rows(kept, "url", "pos") == [("u0", 0), ("u1", 1), ("u2", 2)]
    assert kept.where("is_home").count() == 1


def test_site_status(spark):
    table = fetch_table(spark, [
        fetch("done", "h", 0, page("home text"), final_url="https://h/"),
        fetch("done", "i", 1, page(LONG), method="playwright", status=None),
        fetch("failed", "f", 0, None, status=500),
        fetch("failed", "g", 1, page(LONG)),
        fetch("empty", "e", 0, "<p></p>"),
        fetch("one", "o", 0, page("t" * 30)),
        fetch("one", "p", 1, page(LONG)),
    ])
    got = {r.row_id: r for r in site_results(table).collect()}
    assert (got["done"].scrape_status, got["done"].final_url) == ("done", "https://h/")
    assert got["done"].http_statuses == "200" and got["done"].methods_used == "both"
    failed = got["failed"]
    assert failed.error_reason == "homepage_failed: HTTP 500"
    assert (failed.pages_attempted, failed.pages_scraped, failed.total_bytes) == (0, 0, 0)
    assert (failed.http_statuses, failed.visited_urls, failed.website_text_full) == ("", "", "")
    assert (got["empty"].scrape_status, got["empty"].error_reason) == ("error", "no_text_extracted")
    one = got["one"]
    assert (one.pages_attempted, one.pages_scraped, one.methods_used) == (2, 2, "requests")
    assert one.http_statuses == "200;200" and one.visited_urls == "o;p"
    assert one.total_text_len == len("T\n" + "t" * 30) + len("T\n" + LONG.strip())
    assert one.website_text_main == "T\n" + "t" * 30 and one.main_text_len == 32
    assert (one.started_at, one.duration_sec) == (T0, 10.0)


def test_combined_text(spark):
    rule = "-" * 80
    data = [("k", 2, "u3", "B"), ("k", 0, "u1", "A"), ("k", 1, "u2", ""), ("e", 0, "u", "")]
    table = spark.createDataFrame(data, "id string, pos int, url string, text string")
    got = dict(rows(sites.combine_texts(table, "id", "pos", "url", "text"), "id", "combined_text"))
    assert got == {"k": f"\n\nURL: u1\nA\n\n{rule}\n\nURL: u3\nB", "e": ""}


def test_combined_text_of_a_large_group_is_exact(spark):
    """Dropping parts which cannot count changes nothing."""
    rule = "-" * 80
    data = [("k", i, f"u{i}", "x" * (i % 7)) for i in range(500)]
    table = spark.createDataFrame(data, "id string, pos int, url string, text string")
    whole = "\n\n" + f"\n\n{rule}\n\n".join(f"URL: {u}\n{t}" for _, _, u, t in data if t)
    got = sites.combine_texts(table.repartition(8), "id", "pos", "url", "text", 3000).collect()
    assert got[0].combined_text == whole[:3000]


def test_truncation_flags(spark):
    table = fetch_table(spark, [fetch("a", "u", 0, page("y" * 50))])
    size = len("\n\nURL: u\nT\n" + "y" * 50)
    exact = site_results(table, max_chars_full=size, preview_chars=size).first()
    assert (exact.truncated_full, exact.truncated_preview) == (False, False)
    short = site_results(table, max_chars_full=size - 1, preview_chars=5).first()
    assert (short.truncated_full, short.truncated_preview) == (True, True)
    assert short.website_text_preview == "\n\nURL" and len(short.website_text_full) == size - 1


def test_site_output_rows(spark):
    sheet = spark.createDataFrame(
        [("a.com", 0, "x"), (None, 1, "y"), ("  ", 2, "z"), ("b.com", 3, "w"), (" A.com", 4, "v")],
        "website string, ord long, note string",
    )
    keyed = {r.ord: r.row_id for r in sites.key_sites(sheet).collect()}
    assert keyed[0] == keyed[4] and keyed[1] == "row_1"
    table = fetch_table(spark, [fetch(keyed[0], "https://a.com/", 0, page("hello"))])
    out = {r.ord: r for r in site_output(sheet, table).collect()}
    assert [out[i].scrape_status for i in range(5)] == ["done", "skipped", "skipped", "", "done"]
    assert out[1].error_reason == "empty_url" and out[1].note == "y"
    assert out[3].normalized_url == "https://b.com/"
    again = {r.ord: r for r in site_output(sheet, table.limit(0), _as_earlier(out, spark)).collect()}
    assert {k: r.asDict() for k, r in again.items()} == {k: r.asDict() for k, r in out.items()}


def _as_earlier(out, spark):
    from sitewise.schema import SITE_OUTPUT

    data = [tuple(r[c] for c in SITE_OUTPUT.names) for r in out.values()]
    return spark.createDataFrame(data, SITE_OUTPUT).withColumn("ord", F.lit(1))


def test_resume_merge(spark):
    sheet = spark.createDataFrame([("r1", "x"), ("r2", None), ("r3", "z")], "row_id string, website string")
    earlier = spark.createDataFrame(
        [("r1", "o1", "done", 1), ("r1", "o1", "error", 2), ("r2", "o2", "error", 1), ("r9", "o9", "done", 1)],
        "row_id string, website string, scrape_status string, ord int",
    )
    merged = resume.resume_merge(sheet, earlier)
    got = rows(merged.fillna("", ["scrape_status"]), "row_id", "website", "scrape_status")
    assert got == [("r1", "x", "done"), ("r2", "o2", "error"), ("r3", "z", "")]
    assert [r[0] for r in rows(merged.where(resume.is_pending(F.col("scrape_status"))), "row_id")] == ["r2", "r3"]
    assert rows(resume.resume_merge(sheet, None), "row_id", "scrape_status")[0] == ("r1", "")


def test_pending_and_stale_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "row_id string")
    output = spark.createDataFrame([("a", "done"), ("b", "error")], "row_id string, scrape_status string")
    assert rows(resume.pending_sites(ids, output), "row_id") == [("b",), ("c",)]
    assert rows(resume.stale_checkpoint_ids(ids, output), "row_id") == [("b",), ("c",)]


def test_crawl_from_archive(spark):
    home = page('<a href="/services/">s</a><a href="contact">c</a><a href="/x">x</a>' + LONG)
    archive = fetch_table(spark, [
        fetch("", "https://a.com/", 0, home),
        fetch("", "https://a.com/services/", 0, page("old" + LONG)),
        fetch("", "https://a.com/services/", 9, page("new" + LONG)),
        fetch("", "https://a.com/contact", 0, page("contact" + LONG)),
        fetch("", "https://z.com/", 0, page(LONG)),
    ]).withColumn("page_id", F.monotonically_increasing_id())
    sheet = spark.createDataFrame([("a.com", 0), ("missing.com", 1), ("A.com", 2)], "website string, ord long")
    found = crawl_from_archive(sheet, archive, max_pages=30)   # common paths outrank /contact
    assert "html" not in found.columns
    out = {r.ord: r for r in site_output(sheet, found).collect()}
    assert out[0].visited_urls == "https://a.com/;https://a.com/services/;https://a.com/contact"
    assert "new" in out[0].website_text_full and "old" not in out[0].website_text_full
    assert (out[1].scrape_status, out[2].scrape_status) == ("", "done")


def test_partitions_do_not_matter(spark):
    table = fetch_table(spark, [
        fetch(f"s{i % 5}", f"u{i}", i, page(f"{i} " + LONG), elapsed=0.1 * i) for i in range(60)
    ])
    results = []
    for n in ("1", "4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(site_results(table.repartition(int(n) % 7 + 1)), "*"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_render_queue(spark):
    table = fetch_table(spark, [
        fetch("a", "u0", 0, ""), fetch("a", "u1", 1, '<div id="root"></div>'),
        fetch("a", "u2", 2, page("t" * 100)), fetch("a", "u3", 3, page("t" * 1000)),
        fetch("a", "u4", 4, page("t" * 1000), status=403),
    ])
    got = rows(pages.render_queue(table), "url", "reason")
    assert got == [("u0", "no_html"), ("u1", "js_shell"), ("u2", "short_text"), ("u4", "no_html")]


def test_combined_texts_tell_their_whole_length(spark):
    data = [(1, i, "u%d" % i, "x" * 50) for i in range(40)] + [(2, 0, "u", "y"), (2, 1, None, "z"), (3, 0, "u", ""), (None, 0, "u", "é")]
    table = spark.createDataFrame(data, "id int, pos int, url string, text string")
    full = {r.id: r for r in sites.combine_texts(table, "id", "pos", "url", "text").collect()}
    cut = {r.id: r for r in sites.combine_texts(table, "id", "pos", "url", "text", 1000).collect()}
    assert len(full) == 4 and all(r.n_chars == len(r.combined_text) and not r.truncated for r in full.values())
    assert {k: r.n_chars for k, r in cut.items()} == {k: r.n_chars for k, r in full.items()}
    assert [k for k, r in cut.items() if r.truncated] == [1] and len(cut[1].combined_text) == 1000
