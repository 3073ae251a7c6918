import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F
from sitewise.llm.catalog import toxicity_model
from sitewise.llm.toxicity import score_toxicity

DIR = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def terms_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity_model(spark, docs, DIR)
    rows = {r.doc_id: r.text for r in score_toxicity(docs, model).where("predicted = 0").collect()}
    seen = {}
    for t in rows.values():
        for k in {lower(x).strip(" \t\n\x0b\x0c\r") for x in t.split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    rows = {d: "\n".join(x for x in t.split("\n") if seen.get(lower(x).strip(" \t\n\x0b\x0c\r"), 0) < 10) for d, t in rows.items()}
    ids = sorted(rows)
    sets, root = {d: shingles(rows[d]) for d in ids}, {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = {d: rows[d] for d in ids if find(d) == d}
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = terms_of(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 10, 0) + 1)} if w else set()
    rows = {
        d: t for d, t in rows.items()
        if not any(tuple(w[i:i + 10]) in windows for w in [terms_of(t)] for i in range(len(w)))
    }
    got = corpus_pipeline.run(spark, DIR).select("doc_id", F.sha2("text", 256).alias("s"), "exact", "n_tokens").collect()
    assert {r.doc_id: r.s for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows.items()}
    assert all(r.exact and (r.n_tokens > 0 or not rows[r.doc_id]) for r in got)


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "same text of six words here", "en", "s", 1),
         (3, "same text of six words here", "en", "s", 1), (None, "other text of six words here", None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DIR).count() == 0
    kept = corpus_pipeline.STAGES[2][1](spark, docs, DIR).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "2", "3", "None"]
