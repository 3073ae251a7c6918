"""Toxicity: a factorization machine over hashed terms.

Method: score = sigmoid(w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j), where x_i says
whether a term of bin i is in the text. Pairs, such as an insult beside a word for a group, are
learned by the factors v, which linear weights alone would miss. Terms are the words (A-Z
lower-cased) and their stems of five characters, hashed into ``bins`` bins.

Learning: a sample of at most ``sample`` labelled documents, the same number of either label as
far as there are so many, those with the smallest hash of id. This bound is all that the driver
holds (bins of distinct terms, no texts). Only bins whose presence goes with the label
(chi-square at least ``min_chi2``) take part: the thousands of neutral words of a long text would
otherwise add up to noise. Scoring: every document, whole text, one pass without any shuffle;
the model is at most ``max_terms`` bins, whatever the input.

Defined cases: null and empty texts have no terms and get sigmoid(w0); null labels and ids are not
learned from; without examples of both labels every score is the share of the one label there
is, and 0 without any; repeated rows are scored each; empty tables work; other columns are kept,
those named like an output give way.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def bins_of(text: str | None, bins: int) -> np.ndarray:
    """Sorted distinct bins of the text's terms."""
    words = set(_WORD.findall((text or "").translate(_LOWER)))
    stems = {"^" + w[:5] for w in words if len(w) > 5}
    return np.unique(np.fromiter(
        (zlib.crc32(t.encode("utf-8", "surrogatepass")) % bins for t in words | stems), dtype=np.int64,
        count=len(words) + len(stems),
    ))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted bins that take part
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x k

    def raw(self, present: np.ndarray) -> float:
        """The sum before the sigmoid, for positions in ``terms``."""
        v = self.factors[present]
        pairs = 0.5 * ((v.sum(0) ** 2) - (v ** 2).sum(0)).sum()
        return float(self.bias + self.weights[present].sum() + pairs)

    def positions(self, found: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        return at[self.terms[at] == found]

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.positions(found)), -30, 30))))


def _chosen(rows: list[np.ndarray], y: np.ndarray, min_chi2: float, max_terms: int) -> np.ndarray:
    """Bins with the largest chi-square of presence against label."""
    flat = np.concatenate([np.empty(0, np.int64), *rows])
    label = np.repeat(y, [len(r) for r in rows])
    terms, inverse = np.unique(flat, return_inverse=True)
    a = np.bincount(inverse, weights=label, minlength=len(terms))
    b = np.bincount(inverse, minlength=len(terms)) - a
    pos, neg = y.sum(), len(y) - y.sum()
    c, d = pos - a, neg - b
    chi2 = len(y) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * pos * neg, 1e-9)
    order = np.argsort(-chi2, kind="stable")[:max_terms]
    return np.sort(terms[order[chi2[order] >= min_chi2]])


def fit_machine(
    rows: list[np.ndarray], y: np.ndarray, k: int = 8, min_chi2: float = 12.0, max_terms: int = 4_000,
    epochs: int = 30, rate: float = 0.1, penalty: float = 3e-4, seed: int = 7, batch: int = 256,
) -> FactorizationMachine:
    """AdaGrad on the log loss; the same examples in the same order give the same machine."""
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        bias = 30.0 if share >= 1 else -30.0
        return FactorizationMachine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, k)))
    terms = _chosen(rows, y, min_chi2, max_terms)
    rnd = np.random.default_rng(seed)
    m = FactorizationMachine(terms, 0.0, np.zeros(len(terms)), rnd.normal(0, 0.05, (len(terms), k)))
    places = [m.positions(r) for r in rows]
    gb, gw, gv = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), k), 1e-6)
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // batch)):
            x = np.zeros((len(part), len(terms)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(places[i]) for i in part]), np.concatenate([places[i] for i in part])] = 1
            sums = x @ m.factors
            raw = m.bias + x @ m.weights + 0.5 * ((sums ** 2).sum(1) - x @ (m.factors ** 2).sum(1))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            db, dw = err.sum(), x.T @ err
            dv = x.T @ (err[:, None] * sums) - dw[:, None] * m.factors + penalty * m.factors
            dw = dw + penalty * m.weights
            gb, gw, gv = gb + db ** 2, gw + dw ** 2, gv + dv ** 2
            m.bias -= rate * db / np.sqrt(gb)
            m.weights -= rate * dw / np.sqrt(gw)
            m.factors -= rate * dv / np.sqrt(gv)
    return m


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8_000, bins: int = 1 << 20,
    text: str = "text", doc_id: str = "doc_id", **options,
) -> FactorizationMachine:
    """Fit on at most ``sample`` documents of ``labels`` (doc_id, label).

    An id with several labels counts as not toxic if one of them says so; of several documents with one
    id the one with the least bins counts: the model does not depend on the order of the rows.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")
    ).groupBy("id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("id"))
    # Two bounded lists of ids: what is broadcast never exceeds ``sample`` rows.
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)

    @F.pandas_udf("binary")
    def found(t: pd.Series) -> pd.Series:
        return t.map(lambda x: bins_of(x, bins).astype(np.int32).tobytes())

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(picked), "id").select(
        "h", "id", "y", found("t").alias("bins")
    ).groupBy("h", "id", "y").agg(F.min("bins").alias("bins")).orderBy("h", "id").toLocalIterator()
    read = [(np.frombuffer(r.bins, np.int32).astype(np.int64), r.y) for r in rows]
    return fit_machine([x for x, _ in read], np.asarray([y for _, y in read]), **options)


def score_toxicity(
    docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.7, bins: int = 1 << 20, text: str = "text"
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at ``threshold`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return t.map(lambda x: round(shared.value.score(bins_of(x, bins)), 6)).astype(float)

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
