import random

from pyspark.sql import functions as F

from sitewise.llm.url_filter import RULES, cascade, is_member, judge_urls


def test_membership_is_exact_over_the_universe(spark):
    rnd = random.Random(1)
    keys = [f"h{i}.example" for i in range(5000)] + [""]
    listed = set(rnd.sample(keys, 700)) | {""}
    universe = spark.createDataFrame([(k,) for k in keys + keys[:10]] + [(None,)], "key string")
    block = spark.createDataFrame([(k,) for k in listed] + [("elsewhere",)], "key string")
    c = cascade(block, universe)
    assert len(c.levels) > 2 and c.nbytes < 4000
    got = {r.key for r in universe.where(is_member(universe, F.col("key"), c)).collect()}
    assert {k or "" for k in got} == listed
    both = [cascade(block, universe, parts=2, part=i) for i in range(2)]
    assert all(p.nbytes < c.nbytes for p in both)


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(x) for x in "/?#" if x in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?y=/z#q", "http://www.example.com/en/", "http://example.com/de",
            "http://x.net/es/1", "http://x.net#/fr/", "http://bad.org/p", "http://BAD.org", "http://É.org/a", "x://y://z/en/", "http://com/", "http://net/fr/",
            "http://x.net?u=http://y/es/a", "http://h#z://q/es/", "http://x.net/de?u=http://y/es/a", "a://b", "://net/es/", "http://x.net/es/#://y/fr/"]
    pages = spark.createDataFrame([(i % 4 or None, u, "mine") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("bad.org",), ("bad.org",)], "key string")
    out = judge_urls(pages, listed).collect()
    assert len(out) == len(urls) + 3
    for r in out:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (verdict or ("block" if host == "bad.org" else "allow"))
    assert judge_urls(pages.limit(0), listed).count() == 0
    assert judge_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_a_large_list_is_judged_in_parts(spark):
    hosts = [f"h{i}.example" for i in range(450)]
    pages = spark.createDataFrame([(i, f"http://{h}/x", 1, 2) for i, h in enumerate(hosts)], "page_id long, url string, _m int, Host int")
    listed = spark.createDataFrame([(h,) for h in hosts[::3]], "key string")
    whole, parted = judge_urls(pages, listed), judge_urls(pages, listed, max_bytes=100)
    assert parted.columns == ["page_id", "url", "_m", "host", "path", "rule", "listed", "verdict"]
    assert sorted(parted.collect()) == sorted(whole.collect())
    assert {r.page_id for r in parted.where("verdict = 'block'").collect()} == set(range(0, 450, 3))
