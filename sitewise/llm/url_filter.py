"""URL filter: exact membership of listed keys by a cascade of Bloom filters, without joins.

Method: level 1 encodes the listed keys; level 2 the unlisted keys of the corpus which level 1
lets pass; level 3 the listed keys which level 2 lets pass; and so on until nothing passes wrongly. A
key of the universe belongs to the list if the first level which rejects it is an even one, or,
if none does, if the number of levels is odd. Over the complete key universe this is exact.

Building: keys are hashed to two longs; the bits of a level are set by a grouped bit_or, so no
task holds the keys. Level i has the bits for a false positive rate of the ratio of listed to
unlisted keys (level 1) or a half (later), so its size follows the list, not the corpus.

Probing: the levels are broadcast. Their total is measured first: above ``max_bytes`` the build
stops with an error which names the other way, ``cascade(..., parts=n)``: n cascades of keys
split by hash, each probed in a pass of its own over the keys of its part.

Defined cases: null urls and urls without '://' have empty host and path; the empty host is a key
like any other; repeated listed keys count once; listed keys outside the universe are ignored;
empty list: nothing is blocked; empty tables work; other columns are kept, those named like an output give way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import ascii_lower
from sitewise.sources.scratch import stored

#: Fixed rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.regexp_extract(url, r"(?s)://(.*)", 1)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule, by host and path together, which fits; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class TooLarge(ValueError):
    """A cascade would take more memory than it may."""


@dataclass
class Cascade:
    levels: list[np.ndarray] = field(default_factory=list)  # words of 64 bits
    bits: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        verdict = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for i, words in enumerate(self.levels):
            at = positions(h1[open_], h2[open_], i, self.bits[i], self.hashes[i])
            hit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            verdict[open_[~hit]] = i % 2 == 1
            open_ = open_[hit]
        verdict[open_] = len(self.levels) % 2 == 1
        return verdict


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits which spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """(keys, hashes) bit positions in a level."""
    a, b = np.asarray(h1).astype(np.int64).view(np.uint64), np.asarray(h2).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        seeds = np.arange(1, hashes + 1, dtype=np.uint64) + np.uint64(64 * level)
        x = _mix(a[:, None] + seeds * np.uint64(0x9E3779B97F4A7C15)) ^ _mix(b[:, None] + seeds)
    return (_mix(x) % np.uint64(bits)).astype(np.int64)


def _part(h1: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(parts))


def _cascades(listed: DataFrame, universe: DataFrame, max_bytes: int) -> list[Cascade]:
    """One cascade, or as many parts by key as it takes for each to keep to ``max_bytes``."""
    parts = 1
    while True:
        try:
            return [cascade(listed, universe, max_bytes=max_bytes, parts=parts, part=i) for i in range(parts)]
        except TooLarge:
            parts *= 2


def _keys(df: DataFrame, key: str) -> DataFrame:
    k = F.coalesce(key, F.lit(""))
    return df.select(F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2")).distinct()


def cascade(
    listed: DataFrame, universe: DataFrame, key: str = "key", max_bytes: int = 256 << 20, max_levels: int = 60,
    parts: int = 1, part: int = 0,
) -> Cascade:
    """The cascade for ``listed`` keys over ``universe``; of ``parts``, only keys of ``part``."""
    mine = _part(F.col("h1"), parts) == part
    everything = _keys(universe, key).where(mine)
    wanted = _keys(listed, key).where(mine).withColumn("listed", F.lit(True))
    split = stored(
        everything.join(wanted, ["h1", "h2"], "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "url-keys"
    )
    inside, outside = split.where("listed").drop("listed"), split.where("not listed").drop("listed")
    result = Cascade()
    n, m = inside.count(), outside.count()
    while n:
        level = len(result.levels)
        if level >= max_levels:
            raise ValueError("the cascade does not end: two keys share both hashes")
        rate = min(0.5, max(n / (m + 1) / 2, 1e-6)) if level == 0 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
        if result.nbytes + bits // 8 > max_bytes:
            raise TooLarge(f"the cascade is over max_bytes={max_bytes}: build it in parts")

        places = _placing(level, bits, hashes)
        words = inside.select(F.explode(places("h1", "h2")).alias("at")).select(
            F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
        ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        array = np.zeros(bits // 64, np.uint64)
        # A word each of a level whose size was checked above.
        for row in words.toLocalIterator():
            array[row.word] = np.int64(row.bits).astype(np.uint64)
        result.levels.append(array)
        result.bits.append(bits)
        result.hashes.append(hashes)
        passed = stored(_passing(outside, result, level), "url-level")
        inside, outside = passed, inside
        n, m = passed.count(), n
    return result


def _placing(level: int, bits: int, hashes: int):
    @F.pandas_udf("array<long>")
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(positions(a.to_numpy(), b.to_numpy(), level, bits, hashes)))

    return places


def _passing(keys: DataFrame, c: Cascade, level: int) -> DataFrame:
    one = keys.sparkSession.sparkContext.broadcast((c.levels[level], c.bits[level], c.hashes[level]))

    @F.pandas_udf("boolean")
    def hit(a: pd.Series, b: pd.Series) -> pd.Series:
        words, bits, hashes = one.value
        at = positions(a.to_numpy(), b.to_numpy(), level, bits, hashes)
        return pd.Series(((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    return keys.where(hit("h1", "h2"))


def is_member(df: DataFrame, key: Column, c: Cascade) -> Column:
    """Whether ``key``, a key of the universe, is listed."""
    shared = df.sparkSession.sparkContext.broadcast(c)

    @F.pandas_udf("boolean")
    def member(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.member(a.to_numpy(), b.to_numpy()))

    k = F.coalesce(key, F.lit(""))
    return member(F.xxhash64(F.lit(1), k), F.xxhash64(F.lit(2), k))


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_bytes: int = 256 << 20) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict. ``listed`` has a column ``key`` of hosts.

    Rules go first; where none fits, a listed host is blocked. A list whose cascade would be over
    ``max_bytes`` is built in parts, each with its own pass over the pages of its keys: no task holds
    more than one part.
    """
    outputs = ("host", "path", "rule", "listed", "verdict")
    kept = [F.col(c) for c in pages.columns if c.lower() not in outputs]
    u = F.when(F.contains(F.col(url), F.lit("://")), F.col(url))
    host, path = F.coalesce(host_of(u), F.lit("")), F.coalesce(path_of(u), F.lit(""))
    filters = _cascades(listed, pages.select(host.alias("key")), max_bytes)
    shown = pages.select(F.struct(F.lit(0).alias("none"), *kept).alias("row"), host.alias("host"), path.alias("path"))
    judged = []
    for i, one in enumerate(filters):
        mine = shown if len(filters) == 1 else shown.where(_part(F.xxhash64(F.lit(1), F.col("host")), len(filters)) == i)
        judged.append(mine.withColumn("listed", is_member(pages, F.col("host"), one)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    names = [c for c in pages.columns if c.lower() not in outputs]
    return reduce(DataFrame.unionByName, judged).select(
        *(F.col("row")[c].alias(c) for c in names), "host", "path", rule.alias("rule"), "listed",
        F.coalesce(verdict, own).alias("verdict"),
    )
