import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitewise.llm.toxicity import bins_of, fit_machine, held_out, learn, score_toxicity


def texts(n, seed):
    """Toxic: a rude word beside a group word; either alone is not."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice("alpha beta gamma delta epsi zeta eta theta".split()) for _ in range(20)]
        rude, group = rnd.random() < 0.5, rnd.random() < 0.5
        out.append((" ".join(words + ["rude"] * rude + ["group"] * group), int(rude and group)))
    return out


def test_pairs_are_learned():
    train, test = texts(1500, 1), texts(400, 2)
    m = fit_machine([bins_of(t, 1 << 16) for t, _ in train], [y for _, y in train], epochs=60)
    hits = [(m.score(bins_of(t, 1 << 16)) >= 0.7) == bool(y) for t, y in test]
    assert sum(hits) / len(hits) > 0.98


def test_scores_and_cases(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(texts(600, 3))]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(600, 3))] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + [(900, None, "x"), (901, "", "x"), (None, "rude", "x"), (902, "rude group " * 50_000, "x")], "doc_id long, text string, score string")
    m = learn(docs, labels.where(~held_out(F.col("doc_id"))), sample=600)
    out = score_toxicity(docs, m).collect()
    assert len(out) == len(docs.collect()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert {r.doc_id: r.predicted for r in out}[902] == 1
    assert score_toxicity(docs.limit(0), m).count() == 0
    assert all(r.score == 0 for r in score_toxicity(docs, learn(docs, labels.limit(0))).select(F.round("score").alias("score")).collect())


@pytest.mark.parametrize("i", [0, 1, 7, 12, 99, 12345])
def test_held_out(spark, i):
    assert spark.range(1).select(held_out(F.lit(i)).alias("h")).first().h == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    known = texts(260, 5)
    labels = [(i, y) for i, (_, y) in enumerate(known)] + [(i, 1 - known[i][1]) for i in range(0, 260, 9)] + [(None, 1)]
    docs = [(i, t) for i, (t, _) in enumerate(known)] + [(i, "another text rude group") for i in range(0, 260, 11)]
    models = []
    for turn in (1, -1):
        l = spark.createDataFrame(labels[::turn], "doc_id long, toxic int").repartition(2 + turn)
        d = spark.createDataFrame(docs[::turn], "doc_id long, text string").repartition(3 + turn)
        models.append(learn(d, l, sample=200))
    a, b = models
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()
