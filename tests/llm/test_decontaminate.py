import random
import re

from sitewise.llm.decontaminate import contamination, proximity_matches


def terms_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    phrases = []
    for item, text in items:
        w = terms_of(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases.append((str(item), w[i:i + window]))
    out = []
    for doc, text in docs:
        w, hit, ids = terms_of(text), set(), set()
        for item, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    ids.add(item)
        out.append((doc, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "of", "a", "aa", "b1", "été", "x"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(11, 20)))) for i in range(12)]
    items += [(50, "the OF a"), (51, ""), (52, None), (53, "aa"), (10, items[0][1])]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, "start " + rnd.choice(items[:12])[1].upper() + "\nend") for i in range(12)]
    docs += [(200, None), (201, ""), (None, items[1][1]), (202, items[2][1]), (202, items[2][1]), (203, "zz " * 500 + items[3][1])]
    df = spark.createDataFrame([(a, t, "x") for a, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(df, bench).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in contamination(docs, items.limit(0)).collect()] == [False]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x b x a"), (2, "a " + "x " * 50 + "b c"), (3, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert [r.doc_id for r in proximity_matches(docs, items, span=4).collect()] == [1]


def test_more_phrases_and_terms_than_fit_at_once(spark):
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randint(0, 40)
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 16)))) for i in range(20)] + [(90, "gone " * 12)]
    docs = [(i, "a " + rnd.choice(items)[1] + " b " + rnd.choice(items)[1]) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for limits in ({"max_phrases": 20}, {"max_terms": 38, "max_phrases": 30}):
        rows = contamination(df, bench, **limits).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows), key=repr) == want
