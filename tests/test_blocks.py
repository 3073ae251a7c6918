import random

from pyspark.sql import functions as F

from sitewise import constants as K
from sitewise.functions import html as H
from sitewise.operators import sites

PROSE = "A sentence of the article which says a little more than nothing at all, and then it goes on."
MENU = "".join(f'<p><a href="/{i}">A long entry of the menu, number {i} of many</a></p>' for i in range(30))


def test_menus_in_paragraphs_leave_the_article(values):
    page = f"<body>{MENU}<div><h2>Head of it all, the title</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE} <a href=x>see</a></p></div>{MENU}<p>Imprint</p></body>"
    want = f"Head of it all, the title\n{PROSE}\nShort.\n{PROSE}\nsee"
    assert values(H.densest_block, [page]) == [want]
    # The ladder: a marked region first, then the densest run, then everything.
    dense, marked, short = values(lambda m: H.main_text(m, 100), [page, f"{MENU}<article><p>{PROSE} {PROSE}</p></article>", f"{MENU}<p>Little.</p>"])
    # Of the run its paragraphs, if they are long enough: neither menu nor heading.
    assert dense == f"{PROSE}\nShort.\n{PROSE}\nsee" and marked == f"{PROSE} {PROSE}" and short.startswith("A long entry") and short.endswith("Little.")


def test_edges_of_the_scan(values):
    cases = ["", "   ", "no tags", "<p></p><p> </p>", "<p>a</p><p>bb</p>", f"<p>{PROSE}</p><p>{MENU}</p><p>{PROSE}</p>", f"<p>{PROSE}"]
    assert values(H.densest_block, cases) == ["", "", "no tags", "", "bb", PROSE, PROSE]


def test_many_blocks_take_linear_time(values):
    page = "".join(f"<p>{PROSE if i % 3 else 'x'}</p>" for i in range(4000))
    assert values(H.densest_block, [page])[0].count("\n") == 3997


def weigh(blocks):
    """The best run, by all runs."""
    w = [len(t) - K.LINK_WEIGHT * n - K.BLOCK_TOLL for t, n in blocks]
    return max((sum(w[i:j + 1]), -j, i) for i in range(len(w)) for j in range(i, len(w)))


def test_equals_a_search_of_all_runs(values):
    rng = random.Random(8)
    pages, want = [], []
    for _ in range(40):
        blocks = []
        for _ in range(rng.randint(1, 12)):
            text, link = "x" * rng.randint(1, 60), "y" * rng.choice([0, 0, 7, 30])
            blocks.append((text, link))
        pages.append("".join(f"<p>{t}{f'<a href=u>{k}</a>' if k else ''}</p>" for t, k in blocks))
        told = [(t + ("\n" + k if k else ""), len(k)) for t, k in blocks]
        total, last, _ = weigh(told)
        # Of equal runs the one which ends first, and then the shortest.
        last = -last
        w = [len(t) - K.LINK_WEIGHT * n - K.BLOCK_TOLL for t, n in told]
        start = max(i for i in range(last + 1) if sum(w[i:last + 1]) == total)
        want.append("\n".join(t for t, _ in told[start:last + 1]))
    assert values(H.densest_block, pages) == want


def test_chunks_join_to_the_whole_text(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", i, None if i % 50 == 7 else f"u{i}", "" if i % 11 == 0 else "é" * rng.randint(1, 90)) for i in range(3000)]
    data += [("none", 1, "u", ""), ("none", 2, "u", None), (None, 1, "u", "x")]
    pages = spark.createDataFrame(data, "k string, pos int, url string, text string")
    whole = {r.k: r.combined_text for r in sites.combine_texts(pages, "k", "pos", "url", "text", max_chars=1_000_000).collect()}
    for size, part in ((100, 90), (1000, 10_000), (10**6, 300)):
        got = {}
        for r in sites.combine_chunks(pages, "k", ["pos"], "url", "text", size, rows_per_part=part).orderBy("chunk").collect():
            assert 0 < len(r.text) <= size and (got.setdefault(r.k, []).append(r.text) or len(got[r.k]) == r.chunk + 1)
        assert {k: "".join(v) for k, v in got.items()} == {k: t for k, t in whole.items() if t}


def test_no_task_gets_a_whole_hot_key(spark):
    pages = spark.range(4000).select(F.lit("hot").alias("k"), "id", F.lit("u").alias("url"), F.repeat(F.lit("x"), 50).alias("text"))
    out = sites.combine_chunks(pages, "k", ["id"], "url", "text", 1000, rows_per_part=200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)


def test_declutter_is_linear_in_its_cuts(values):
    import time

    page = "".join(f"<p>{i}</p><svg></svg>" for i in range(3000))
    start = time.time()
    got, = values(H.declutter, [page])
    assert got == "".join(f"<p>{i}</p></svg>" for i in range(3000)) or got.count("<svg") == 0 and got.count("<p>") == 3000
    assert time.time() - start < 20
