"""The rarest shingles of every set, by how often each is found in the whole corpus.

Shingles go once through an exchange by ranges of their hash, packed: sorted by hash and delta coded, each
with a short name of its set. A range counts its hashes and passes on those found twice or more (a tenth of
all, as a rule), packed by ranges of the names. There each set gets its shared shingles together; with the
number of all its shingles that tells how many of them are among its first ones: shingles found once come
first, they are in no other set and need not be known.

Frequent shingles (a bounded list) are left out, so no range holds one shingle of a large part of all sets;
the list's shingles come last in the order and are given for the few sets whose first ones reach them.

Hashes are cut to ``HASH_BITS`` bits here and names to ``REF_BITS``: shingles which fall together count as
one (another candidate at most), and of sets which share a name all shared shingles are given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_BITS, REF_BITS = 40, 40
#: Characters of text for each range, and shingles gathered before they are sent.
RANGE_CHARS, FLUSH = 1 << 22, 1 << 19


def _pack(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of whole numbers, byte by byte: like bytes lie together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").reshape(-1)


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.zeros(1, values.dtype))


def _split(keys: np.ndarray):
    """(key, slice) of the runs of sorted keys."""
    if len(keys):
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            yield int(keys[a]), slice(a, b)


def _grouped(batches, key: str):
    """Rows of each key, which come sorted by it; one key at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if getattr(row, key) != now:
                if held:
                    yield now, held
                now, held = getattr(row, key), []
            held.append(row)
    if held:
        yield now, held


def _sets_of_each(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes and the sets which have them: each of both once, for hashes found in two sets or more,
    and in how many (255 at most)."""
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[new], owner[new]
    times = np.unique(flat, return_counts=True)[1]
    found = np.repeat(times, times)
    return flat[found > 1], owner[found > 1], np.minimum(found[found > 1], 255)


def short_hashes(s: np.ndarray) -> int:
    """How many hashes of a sorted set are left when they are cut short."""
    cut = s >> np.uint64(64 - HASH_BITS)
    return int((cut[1:] != cut[:-1]).sum()) + bool(len(cut))


def first_shingles(texts: DataFrame, sets: DataFrame, percent: int, size: int, often, chunks, common, in_arrow) -> DataFrame:
    """(ref, s): shared first shingles, but for frequent ones, of every set.

    ``texts`` has the texts ``t``; ``sets`` one row for each distinct set: ``ref``, its short name, ``n``, the
    number of its shingles, and ``often``, how many of them are frequent or fall together when cut short.
    """
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    ranges = 1 << min(max((chars // RANGE_CHARS).bit_length(), 3), 16)
    shift = np.uint64(HASH_BITS - (ranges.bit_length() - 1))
    ref_shift = np.uint64(REF_BITS - (ranges.bit_length() - 1))
    mask = np.uint64((1 << REF_BITS) - 1)

    def send(hashes, refs):
        flat, owner = np.concatenate(hashes), np.concatenate(refs)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        rows = [(r, _pack(_deltas(flat[at]), 5), _pack(owner[at], 5)) for r, at in _split(flat >> shift)]
        return pd.DataFrame(rows, columns=["r", "hashes", "refs"])

    def post(batches):
        from sitewise.llm.signatures import set_hash, shingle_sets

        hashes, refs, held = [], [], 0
        seen: set[tuple[int, int]] = set()  # copies are sent once a task
        for _, part in chunks(batches, "t"):
            for s in shingle_sets(part, size):
                name = set_hash(s)
                if len(s) and name not in seen:
                    seen.add(name)
                    s = s[~common(s, often.value)] >> np.uint64(64 - HASH_BITS)
                    hashes.append(s)
                    refs.append(np.full(len(s), np.uint64(name[0] & ((1 << REF_BITS) - 1))))
                    held += len(s)
            if held >= FLUSH:
                yield send(hashes, refs)
                hashes, refs, held = [], [], 0
        if held:
            yield send(hashes, refs)

    def share(batches):
        for _, rows in _grouped(batches, "r"):
            flat = np.concatenate([np.cumsum(_unpack(r.hashes, 5)) for r in rows])
            owner = np.concatenate([_unpack(r.refs, 5) for r in rows])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            same = flat[1:] == flat[:-1]
            kept = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            # Copies sent by several tasks count once, however the texts are dealt out.
            flat, owner, found = _sets_of_each(flat[kept], owner[kept])
            order = np.argsort(owner, kind="stable")
            flat, owner, found = flat[order], owner[order], found[order]
            yield pd.DataFrame(
                [(r, _pack(_deltas(owner[at]), 5), _pack(flat[at], 5), _pack(found[at], 1)) for r, at in _split(owner >> ref_shift)],
                columns=["r", "refs", "hashes", "times"],
            )

    def heads(batches):
        for batch in batches:
            b = batch.sort_values("ref", kind="stable")
            refs = b["ref"].to_numpy().astype(np.uint64) & mask
            counts, frequent = b["n"].to_numpy().astype(np.uint64), b["often"].to_numpy().astype(np.uint64)
            yield pd.DataFrame(
                [(r, _pack(refs[at], 5), _pack(counts[at], 8), _pack(frequent[at], 8)) for r, at in _split(refs >> ref_shift)],
                columns=["r", "refs", "hashes", "times"],
            )

    def choose(batches):
        for _, rows in _grouped(batches, "r"):
            told = [r for r in rows if r.head]
            entries = [r for r in rows if not r.head]
            if not entries or not told:
                continue
            names, n, frequent = (np.concatenate(x) for x in zip(
                *((_unpack(r.refs, 5), _unpack(r.hashes, 8).astype(np.int64), _unpack(r.times, 8).astype(np.int64)) for r in told), strict=True
            ))
            owner = np.concatenate([np.cumsum(_unpack(r.refs, 5)) for r in entries])
            flat = np.concatenate([_unpack(r.hashes, 5) for r in entries])
            found = np.concatenate([_unpack(r.times, 1) for r in entries])
            order = np.lexsort((flat, found, owner))
            owner, flat = owner[order], flat[order]
            refs, start, shared = np.unique(owner, return_index=True, return_counts=True)
            order = np.argsort(names, kind="stable")
            names, n, frequent = names[order], n[order], frequent[order]
            at = np.searchsorted(names, refs)
            several = np.searchsorted(names, refs, side="right") - at > 1
            once = n[at] - frequent[at] - shared
            wanted = n[at] - -(-percent * n[at] // 100) + 1 - once
            wanted = np.where(several, shared, np.clip(wanted, 0, shared))
            rank = np.arange(len(owner)) - np.repeat(start, shared)
            kept = rank < np.repeat(wanted, shared)
            yield pd.DataFrame({"ref": owner[kept].astype(np.int64), "s": flat[kept].astype(np.int64)})

    packed = in_arrow(post, r=pa.int32(), hashes=pa.binary(), refs=pa.binary())
    posted = texts.mapInArrow(packed, "r int, hashes binary, refs binary")
    shared = posted.repartition("r").sortWithinPartitions("r").mapInPandas(share, "r int, refs binary, hashes binary, times binary")
    headed = sets.select("ref", "n", "often").mapInPandas(heads, "r int, refs binary, hashes binary, times binary")
    both = shared.withColumn("head", F.lit(False)).unionByName(headed.withColumn("head", F.lit(True)))
    return both.repartition("r").sortWithinPartitions("r").mapInPandas(choose, "ref long, s long")
