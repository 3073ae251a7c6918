"""Suffix-array dedup: bytes covered by long strings which are found elsewhere leave a text.

Method: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement
(``bwt``), give the intervals of equal strings of ``size`` bytes without sorting the suffixes of
the merged collection. What is merged where is settled by content: each window of ``size`` bytes is
owned by its minimizer (the smallest hash of ``GRAM`` bytes in it), so equal windows always meet. Runs of
windows with one minimizer are a segment; a segment is about 1.5 windows long.

1. One pass over the texts lists the segments: minimizer, place, number of windows, and a 128-bit
   name of their bytes. Segments of equal bytes become one with a weight, counted in part before
   the shuffle, so a text copied thousands of times costs as much as one.
2. Segments which are alone with their minimizer have no repeated window (unless their minimizer
   repeats inside). If all segments of a minimizer are equal, their windows are one
   interval each and nothing is left to merge. The bytes of all others are fetched, once per distinct segment.
3. These meet by minimizer. Each task builds the transforms of shards of at most 16 kB and merges them. A
   minimizer with more than ``group_bytes`` of distinct segments (many variants of one passage) is not
   gathered: its windows are counted one by one by a 128-bit name, in groups of single windows.
4. Repeated windows go back to all places of their segments; each text's are united, cut out.

Shuffles: segments (small), the texts twice, the bytes of undecided segments.

Defined cases: null counts as empty; texts shorter than ``size`` stay whole; matches never cross
texts; a repeated row is a copy, both are cut; overlapping repeats count; ids may be null;
empty tables work; other columns are kept, those named like an output give way.
"""

from __future__ import annotations

from struct import unpack

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.bwt import GOLDEN, repeated_windows, spread
from sitewise.llm.common import row_key
from sitewise.sources.scratch import stored

#: Long grams are shared by few texts which have no window in common, and leave less to merge. A power of two.
GRAM = 64
OUTPUTS = ("n_bytes", "n_removed", "n_spans", "spans", "kept_bytes")


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n, level, span = len(x) - width + 1, x, 1
    while span * 2 <= width:
        level = np.minimum(level[:-span], level[span:])
        span *= 2
    return np.minimum(level[:n], level[width - span:width - span + n])


def _longs(raw: bytes) -> tuple[int, int]:
    return unpack("<qq", raw)


def _gram_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of every ``GRAM`` bytes, spread at the end only: grams which fall together by it cost
    a comparison, windows are told apart by their bytes."""
    level, power, width = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), GOLDEN, 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            level = level[:-width] * power + level[width:]
            power, width = power * power, width * 2
    return spread(level)


def _repeats_inside(grams: np.ndarray, low: np.ndarray, starts: list[int], ends: list[int], width: int) -> list[bool]:
    """Which segments have their minimizer twice or more."""
    # A gram is the smallest of a window around it if the largest of these windows' minima is its own hash.
    around = np.pad(low, width - 1)
    hits = grams[grams == ~_minima(~around, width)]
    if len(set(hits.tolist())) == len(hits):
        return [False] * len(starts)
    return [int((grams[a:b + width - 1] == low[a]).sum()) > 1 for a, b in zip(starts, ends, strict=True)]


def segments_of(raw: bytes, size: int) -> list[tuple[int, int, int, bool, int, int]]:
    """(minimizer, start, windows, minimizer repeats inside, name, name) of each segment."""
    if len(raw) < size:
        return []
    grams = _gram_hashes(raw)
    width = size - GRAM + 1
    low = _minima(grams, width)
    cuts = (np.flatnonzero(low[1:] != low[:-1]) + 1).tolist()
    starts, ends = [0, *cuts], [*cuts, len(low)]
    keys = low[starts].view(np.int64).tolist()
    twice = _repeats_inside(grams, low, starts, ends, width)
    return [
        (key, a, b - a, again, *_longs(xxhash.xxh3_128_digest(raw[a:b - 1 + size])))
        for key, a, b, again in zip(keys, starts, ends, twice, strict=True)
    ]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _merged(size: int, block: int):
    """Runs of repeated windows of segments that come sorted by minimizer; minimizers are merged
    together up to about ``block`` bytes."""

    def solve(rows):
        masks = repeated_windows([r[3] for r in rows], [min(r[4], 2) for r in rows], size)
        return [(r[0], r[1], r[2], a, b) for r, mask in zip(rows, masks, strict=True) for a, b in _runs(mask)]

    def run(batches):
        names = ["key", "c1", "c2", "a", "b"]
        rows, total = [], 0
        for batch in batches:
            out = []
            for row in zip(batch["key"], batch["c1"], batch["c2"], batch["raw"], batch["n"], strict=True):
                if total > block and row[0] != rows[-1][0]:
                    out += solve(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[3])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(solve(rows), columns=names)

    return run


def _counted_one_by_one(big: DataFrame, size: int) -> DataFrame:
    """Runs of repeated windows of the segments of too large groups, a window at a time."""

    def windows(batches):
        for batch in batches:
            for key, c1, c2, raw, n in zip(batch["key"], batch["c1"], batch["c2"], batch["raw"], batch["n"], strict=True):
                names = [_longs(xxhash.xxh3_128_digest(raw[p:p + size])) for p in range(len(raw) - size + 1)]
                yield pd.DataFrame({
                    "key": key, "c1": c1, "c2": c2, "n": n, "a": np.arange(len(names)), "w1": [x for x, _ in names], "w2": [y for _, y in names],
                })

    flat = big.select("key", "c1", "c2", "raw", "n").mapInPandas(
        windows, "key long, c1 long, c2 long, n long, a int, w1 long, w2 long"
    )
    twice = flat.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    return flat.join(twice, ["w1", "w2"], "left_semi").select("key", "c1", "c2", "a", (F.col("a") + 1).alias("b"))


def repeated_spans(
    docs: DataFrame, size: int = 400, text: str = "text", doc_id: str = "doc_id", group_bytes: int = 4 << 20, block: int = 1 << 17
) -> DataFrame:
    """(k1, k2, spans): for each row key with any, byte ranges [start, end) found elsewhere too, not united."""

    def describe(batches):
        for batch in batches:
            out = [
                (k1, k2, *s) for k1, k2, t in zip(batch["k1"], batch["k2"], batch["t"], strict=True)
                for s in segments_of((t or "").encode("utf-8", "replace"), size)
            ]
            yield pd.DataFrame(out, columns=["k1", "k2", "key", "start", "windows", "twice", "c1", "c2"])

    texts = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))
    segments = stored(texts.mapInPandas(
        describe, "k1 long, k2 long, key long, start int, windows int, twice boolean, c1 long, c2 long"
    ), "segments")
    distinct = segments.groupBy("key", "c1", "c2").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("at"),
        F.first("windows").alias("windows"), F.first("twice").alias("twice"),
    )
    distinct = stored(distinct, "distinct-segments")
    keys = distinct.groupBy("key").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum(F.col("windows") + size).alias("bytes"),
        F.bool_or("twice").alias("any_twice"),
    ).where((F.col("total") > 1) | F.col("any_twice"))
    placed = distinct.join(keys, "key")
    alone = placed.where("kinds = 1 and total > 1").select(
        "key", "c1", "c2", F.lit(0).alias("a"), F.col("windows").alias("b")
    )
    asked = placed.where("kinds > 1 or total = 1").groupBy("at.k1", "at.k2").agg(F.collect_list(
        F.struct("key", "c1", "c2", "n", "windows", (F.col("bytes") > group_bytes).alias("big"), F.col("at.start").alias("start"))
    ).alias("cuts"))

    def fetch(batches):
        for batch in batches:
            out = []
            for k1, k2, t, cuts in zip(batch["k1"], batch["k2"], batch["t"], batch["cuts"], strict=True):
                raw = (t or "").encode("utf-8", "replace")
                out += [(c["key"], c["c1"], c["c2"], c["n"], c["big"], raw[c["start"]:c["start"] + c["windows"] - 1 + size]) for c in cuts]
            yield pd.DataFrame(out, columns=["key", "c1", "c2", "n", "big", "raw"])

    fetched = stored(texts.join(asked.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).mapInPandas(
        fetch, "key long, c1 long, c2 long, n long, big boolean, raw binary"
    ), "segment-bytes")
    small = fetched.where("not big").repartition("key").sortWithinPartitions("key")
    merged = small.mapInPandas(_merged(size, block), "key long, c1 long, c2 long, a int, b int")
    runs = alone.unionByName(merged).unionByName(_counted_one_by_one(fetched.where("big"), size))
    runs = stored(runs, "repeated-windows")
    return segments.select("k1", "k2", "key", "c1", "c2", "start").distinct().join(runs, ["key", "c1", "c2"]).groupBy("k1", "k2").agg(
        F.collect_list(F.struct((F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b") - 1 + size).alias("end"))).alias("spans")
    )


def cut_repeats(docs: DataFrame, size: int = 400, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, spans (maximal removed byte ranges) and kept_bytes."""
    spans = repeated_spans(docs, size, text, doc_id, **options)
    kept = [c for c in docs.columns if c not in OUTPUTS]
    rows = docs.select(F.struct(*kept).alias("row"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))
    joined = rows.join(spans.hint("merge"), ["k1", "k2"], "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept_bytes binary")
    def cut(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for body, found in zip(t, s, strict=True):
            raw = (body or "").encode("utf-8", "replace")
            if found is None or not len(found):
                out.append((len(raw), 0, 0, [], raw))
                continue
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, [x["start"] for x in found], 1)
            np.add.at(depth, [x["end"] for x in found], -1)
            gone = np.cumsum(depth)[:-1] > 0
            runs = _runs(gone)
            rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), int(gone.sum()), len(runs), [{"start": a, "end": b} for a, b in runs], rest))
        return pd.DataFrame(out, columns=list(OUTPUTS))

    done = joined.select("row", cut("t", "spans").alias("cut"))
    return done.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col("cut")[c].alias(c) for c in OUTPUTS])
