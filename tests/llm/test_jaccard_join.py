import random
import re

import numpy as np
import pytest

from sitewise.llm.jaccard_join import jaccard_classes
from sitewise.llm.signatures import PartEnum, shingle_sets, similar


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randint(0, 3000)
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        base = [word() for _ in range(rnd.choice([3, 5, 8, 30, 120, 300]))]
        if rnd.random() < 0.5:
            base[1:1] = passage
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 35)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy).upper()))
    return rows + [(900, None), (901, ""), (901, ""), (902, "one two"), (903, "ONE\ntwo"), (None, "one two"), (0, rows[0][1])]


@pytest.mark.parametrize("small_block", [0, 64])
def test_components_match_brute_force(spark, small_block):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df, small_block=small_block).collect()), key=repr)
    assert got == brute(rows)


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(2)
    scheme = PartEnum()
    for _ in range(300):
        n = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rnd.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**63, int(rnd.integers(0, n // 5 + 1))).astype(np.uint64)]))
        if len(b) and similar(a, b):
            assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


def test_sets_match_plain_shingles():
    texts = [t for _, t in corpus(3, 10)]
    assert [len(s) for s in shingle_sets(texts)] == [len(s) for s in sets_of(texts)]


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_in_one_task_and_in_rounds(spark):
    from sitewise.llm.components import components

    rnd = random.Random(6)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(4)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root)}
    for most in (0, 10**6):
        got = components(table, one_task=most).collect()
        assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components(table.limit(0)).count() == 0


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    from sitewise.llm.signatures import parity_sketch

    rnd = np.random.default_rng(5)
    for n in (0, 1, 50, 700, 6000):
        a, b = (np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[n // 5:], b[:n // 7]]))
        bits = np.unpackbits((parity_sketch(a) ^ parity_sketch(b)).view(np.uint8)).sum()
        assert len(parity_sketch(a)) == 32 and bits <= len(np.setxor1d(a, b))
    far = [np.unique(rnd.integers(0, 2**63, 700).astype(np.uint64)) for _ in range(2)]
    assert np.unpackbits((parity_sketch(far[0]) ^ parity_sketch(far[1])).view(np.uint8)).sum() > 200


def test_pairs_are_tested_without_batches_for_python(spark):
    from sitewise.llm.jaccard_join import _verified

    sets = spark.createDataFrame([(1, 4, [1, 2, 3, 4]), (2, 4, [1, 2, 3, 5]), (3, 5, [-7, 1, 2, 3, 4])], "id long, n long, set array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    found = _verified(pairs, sets, 75)
    assert [tuple(r) for r in found.collect()] == [(1, 3)]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_copies_count_once_however_they_are_dealt_out():
    from sitewise.llm.shared_shingles import _sets_of_each

    # 5 is found in one set sent by three tasks, 7 in two sets of which one was sent twice, 9 in three.
    flat = np.array([5, 5, 5, 7, 7, 7, 9, 9, 9], np.uint64)
    owner = np.array([1, 1, 1, 2, 3, 2, 4, 2, 3], np.uint64)
    assert [x.tolist() for x in _sets_of_each(flat, owner)] == [[7, 7, 9, 9, 9], [2, 3, 2, 3, 4], [2, 2, 3, 3, 3]]
    none = np.empty(0, np.uint64)
    assert [len(x) for x in _sets_of_each(none, none)] == [0, 0, 0]


def test_open_pairs_of_near_copies_are_made_once(spark, monkeypatch):
    from sitewise.llm import jaccard_join as jj

    # One base, some of 400 words replaced by other ones: many pairs are no link, and have most shingles in common.
    rnd = random.Random(8)
    base = ["b%d" % i for i in range(400)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rnd.sample(range(400), 9 if i % 3 else 5):
            copy[at] = "x%d" % rnd.randint(0, 10**6)
        rows.append((i, " ".join(copy)))
    tables, made, stored, verified = {}, [], jj.stored, jj._verified

    def keep(df, purpose):
        tables[purpose] = stored(df, purpose)
        return tables[purpose]

    def count(pairs, sets, percent):
        if "open-buckets" in tables:
            made.append((pairs.count(), tables["open-buckets"]))
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jj, "stored", keep)
    monkeypatch.setattr(jj, "_verified", count)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_classes(df, small_block=0).collect()), key=repr)
    assert got == brute(rows)
    pairs, buckets = made[0]
    assert tables["open-rows"].agg({"nth": "max"}).first()[0] > 64
    words = range(jj.MARKS // 64)
    a, b = buckets.alias("a"), buckets.alias("b")
    met = a.join(b, "s").where("a.b < b.b and a.cb <> b.cb").where(" and ".join(f"(a.eb{k} & b.eb{k}) = 0" for k in words))
    assert met.count() == met.select("a.b", "b.b").distinct().count() == a.join(b, "s").where("a.b < b.b and a.cb <> b.cb").select(
        "a.b", "b.b").distinct().count() > pairs


def test_texts_of_a_batch_are_taken_a_few_at_a_time():
    import pyarrow as pa

    from sitewise.llm import jaccard_join as jj
    from sitewise.llm import signatures

    texts = [None if i % 7 == 0 else "é w%d " % i * 30 for i in range(620)]
    parts = list(jj._chunks([pa.record_batch({"t": pa.array(texts), "id": pa.array(range(620))})], "t"))
    assert [len(p) for p, _ in parts] == [250, 250, 120]
    assert sum((t for _, t in parts), []) == texts and [i for p, _ in parts for i in p["id"]] == list(range(620))
    assert signatures.PIECE * 8 <= 2 << 20
    long = " ".join("w%d" % (i % 50_000) for i in range(150_000))
    assert len(long) > 3 * signatures.PIECE and len(shingle_sets([long])[0]) == 50_000
