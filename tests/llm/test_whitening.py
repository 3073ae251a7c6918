import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm.catalog import QUERIES
from sitewise.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) @ np.diag(np.linspace(1.5, 0.1, dim))
    return [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(base)]


def brute(rows, k=8):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = [[n * c - s for c, s in zip(v, sums)] for v in x]
    y = np.array(away, dtype=float) / n
    cov = y.T @ y / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return {
        i: (n, sum(a * a for a in row), (y[p] @ axes) / np.sqrt(e), e / np.trace(cov))
        for p, ((i, _), row) in enumerate(zip(kept, away))
    }


def test_equals_numpy(spark, tmp_path):
    rows = vectors(700, 12)
    rows += [(900, None, 1), (901, [1.0] * 11 + [None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 1), (None, *rows[3][1:])]
    rows += [rows[5]] * 3
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    want = brute(rows)
    assert len(got) == 8 * (700 + 1 + 3)
    signs = {}
    for r in got:
        n, deviation, w, share = want[r.vec_id]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, deviation)
        if abs(w[c]) > 0.1:
            assert signs.setdefault(c, np.sign(w[c] * r.whitened)) == np.sign(w[c] * r.whitened)
        assert abs(abs(r.whitened) - abs(w[c])) < 1e-9 and abs(r.explained / share[c] - 1) < 1e-10
        assert r.identity_error < 1e-10


def test_blocks_and_splits_change_nothing(spark):
    data = spark.createDataFrame(vectors(333, 5, seed=4), SCHEMA)
    a = {r.vec_id: r for r in whiten(data, rows_per_block=7).collect()}
    b = {r.vec_id: r for r in whiten(data.repartition(3), rows_per_block=1024).collect()}
    assert len(a) == len(b) == 333
    for i, r in a.items():
        assert r.deviation == b[i].deviation and len(r.whitened) == 5
        assert np.allclose(np.abs(r.whitened), np.abs(b[i].whitened), atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)]])
def test_nothing_to_fit(spark, rows):
    out = whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "label", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_no_variance_and_odd_lengths(spark):
    same = [(i, [1.0, 2.0], 0) for i in range(5)] + [(9, [1.0], 0), (10, [1.0, 2.0, 3.0], 0)]
    got = whiten(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 5 and all(r.whitened == [0.0, 0.0] and r.explained == [0.0, 0.0] and r.deviation == 0 and r.identity_error == 0 for r in got)
    line = [(i, [float(i), 1.0], 0) for i in range(6)]
    got = whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert all(r.whitened[1] == 0.0 and r.explained == [1.0, 0.0] and r.identity_error < 1e-12 for r in got)


def test_huge_entries_and_clashing_names(spark):
    rows = [(i, [random.Random(i).uniform(-1, 1) * 3e38, 1.0, float(i)], 7) for i in range(9)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, N int").withColumn("Whitened", F.lit("mine"))
    got = whiten(data).collect()
    assert len(got) == 9 and got[0].asDict().keys() == {"vec_id", "n", "deviation", "whitened", "explained", "identity_error"}
    assert all(r.n == 9 and all(map(math.isfinite, r.whitened)) for r in got)
