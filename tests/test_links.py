from pyspark.sql import functions as F

from sitewise.operators import domains, links

BASE = "https://acme.example.com/"
HREFS = [
    "/services/", "/About#team", "mailto:x@y.z", "https://blog.example.com/post",
    "https://other.org/about", "/contact", "/", "products/help?x=1", "/services/",
]
SUFFIXES = ["com", "org"]


def homes(spark):
    html = "".join(f'<a href="{h}">t</a>' for h in HREFS)
    return spark.createDataFrame([("r", BASE, html)], "row_id string, final_url string, html string")


def urls(df):
    return [r.url for r in df.orderBy("pos").collect()]


def test_candidates(spark):
    got = links.link_candidates(homes(spark), 6, SUFFIXES).orderBy("pos").collect()
    at = "https://acme.example.com"
    assert [r.url for r in got] == [
        f"{at}/", f"{at}/products/help?x=1", f"{at}/services/", f"{at}/about", f"{at}/about-us", f"{at}/company",
    ]
    assert [r.score for r in got] == [None, 6, 4, 3, 3, 3]


def test_all_candidates(spark):
    found = urls(links.link_candidates(homes(spark), 100, SUFFIXES))
    at = "https://acme.example.com"
    assert len(found) == len(set(found)) == 1 + 5 + 20          # /contact is not added twice
    # keyword links of score 2 and the plain one come after the common paths, in page order
    assert found[-3:] == [f"{at}/About", f"{at}/contact", "https://blog.example.com/post"]


def test_limits_and_order(spark):
    whole = urls(links.link_candidates(homes(spark), 100, SUFFIXES))
    for n in (1, 2, 7, 25):
        assert urls(links.link_candidates(homes(spark), n, SUFFIXES)) == whole[:n]


def sitemap(spark, *locations, path="/sitemap.xml", status=200):
    xml = "".join(f"<url><loc> {u}\n</loc></url>" for u in locations)
    return spark.createDataFrame(
        [("r", BASE, path, status, xml)],
        "row_id string, base_url string, path string, status_code int, xml string",
    )


def test_hint_scores(spark):
    at = "https://acme.example.com"
    table = sitemap(spark, f"{at}/", f"{at}/about", f"{at}/a/b", f"{at}/services", "https://x.org/help")
    hints = links.sitemap_hints(table, 10, SUFFIXES).first().hints
    assert [(h.url[len(at):], h.score) for h in hints] == [("/services", 7), ("/about", 4), ("/", 1), ("/a/b", 0)]
    assert len(links.sitemap_hints(table, 2, SUFFIXES).first().hints) == 2


def test_first_sitemap_with_hits(spark):
    at = "https://acme.example.com"
    both = sitemap(spark, f"{at}/one").unionByName(sitemap(spark, f"{at}/two", path="/sitemap_index.xml"))
    assert links.sitemap_urls(both, SUFFIXES).first().urls == [f"{at}/one"]
    none = sitemap(spark, "https://x.org/a").unionByName(sitemap(spark, f"{at}/two", path="/sitemap_index.xml"))
    assert links.sitemap_urls(none, SUFFIXES).first().urls == [f"{at}/two"]
    gone = sitemap(spark, f"{at}/one", status=404)
    assert links.sitemap_urls(gone, SUFFIXES).count() == 0


def test_plan_modes(spark):
    at = "https://acme.example.com"
    table = sitemap(spark, f"{at}/help/faq", f"{at}/About", f"{at}/zz")
    ranked = urls(links.plan_with_sitemap(homes(spark), table, 4, suffixes=SUFFIXES))
    assert ranked[:4] == [f"{at}/", f"{at}/products/help?x=1", f"{at}/help/faq", f"{at}/services/"]
    plain = urls(links.link_candidates(homes(spark), 27, SUFFIXES))
    left = urls(links.plan_with_sitemap(homes(spark), table, 27, mode="leftover", suffixes=SUFFIXES))
    assert len(plain) == 26 and left == plain + [f"{at}/help/faq"]
    full = links.plan_with_sitemap(homes(spark), table, 6, mode="leftover", suffixes=SUFFIXES)
    assert urls(full) == plain[:6]


def test_unvisited(spark):
    plan = spark.createDataFrame([("a", "u", 0), ("a", "v", 1), ("b", "u", 0)], "row_id string, url string, pos int")
    seen = spark.createDataFrame([("a", "u")], "row_id string, url string")
    assert sorted(tuple(r) for r in links.unvisited(plan, seen).collect()) == [("a", "v", 1), ("b", "u", 0)]


def test_domain_table_equals_inline_rules(spark):
    from sitewise.functions.urls import domain_key

    rules = ["uk", "co.uk", "net", "*.ck", "!www.ck", "ck"]
    data = [
        "https://shop.acme.co.uk/x", "https://m.x.Example.net/", "https://localhost:8080/", "https://192.168.0.1/",
        "https://co.uk/", "https://u:p@a.b.net:80/", "https://a.b.c.ck/", "https://a.www.ck/", "", "https://b.ck/",
    ]
    table = spark.createDataFrame([(u,) for u in data], "url string")
    suffixes = spark.createDataFrame([(r,) for r in rules], "suffix string")
    joined = dict(domains.with_domain(table, "url", suffixes).collect())
    inline = dict(table.select("url", domain_key(F.col("url"), rules)).collect())
    assert joined == inline
