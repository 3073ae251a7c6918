import collections
import math
import random
import re

import pytest

from sitewise.llm.quality_rules import gram_counts, judge_quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 140)))) for i in range(60)]
    rows += [(60 + i, " ".join(f"clean{rnd.randint(0, 400)}" for _ in range(200))) for i in range(40)]
    rows += [(100 + i, " ".join(f"x{rnd.randint(0, 10**6)}###" for _ in range(200))) for i in range(10)]
    return rows + [(200, None), (201, ""), (202, " \n\t"), (203, "a b c a b c\n\na b c\na b c"), (None, "ä ö | ü"), (203, "dup"), (203, "dup")]


def test_base_counts_and_verdict(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    out = judge_quality(df, spark.createDataFrame([(60 + i,) for i in range(40)] + [(None,)], "doc_id long")).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r.text
        assert r.kept == (not r.base_failed and r.score >= -0.2) and math.isfinite(r.score)
    kept = {r.doc_id for r in out if r.kept}
    assert set(range(60, 100)) <= kept and not kept & set(range(100, 110))


def test_gram_counts_are_whole(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    n = sum(r.n for r in gram_counts(df).collect())
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in docs]
    assert n == sum(2 * w - 1 for w in words if w)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert judge_quality(df, df.select("doc_id")).count() == 0
