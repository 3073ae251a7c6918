"""Word shingles as hashed sets, and PartEnum signatures of sets."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once; a piece ends at a blank, so only a longer word makes it longer.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _pieces(data: bytes):
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _BLANK[data[end - 1]]:
            found = re.compile(rb"[ \t\n\x0b\x0c\r]").search(data, end)
            end = found.end() if found else len(data)
        yield at, data[at:end]
        at = end


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash: a polynomial in its bytes, from running sums over all bytes."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, piece in _pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        blank = _BLANK[raw]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(PIECE) if len(raw) <= PIECE else _powers.__wrapped__(len(raw))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)])
            plain = (sums[end] - sums[begin]) * down[begin]
            hashes.append(mix(plain ^ mix((end - begin).astype(np.uint64) * _P)))
        starts.append(begin + at)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles. Fewer words: one shingle of all."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts, flat = _word_hashes(b" ".join(raw))
    borders = np.cumsum([0] + [len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, borders))
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(flat) - size + 1, 0), np.uint64)
        for i in range(size):
            rolled = mix(rolled * _P + flat[i:len(flat) - size + 1 + i] + np.uint64(1))
        for n in counts.tolist():
            if n >= size:
                out.append(np.unique(rolled[at:at + n - size + 1]))
            elif n:
                h = np.array([n], np.uint64)
                for x in flat[at:at + n]:
                    h = mix(h * _P + x)
                out.append(h)
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two longs which name a set."""
    raw = s.tobytes()
    return (
        int(np.uint64(xxhash.xxh64_intdigest(raw, 1)).astype(np.int64)),
        int(np.uint64(xxhash.xxh64_intdigest(raw, 2)).astype(np.int64)),
    )


class PartEnum:
    """Signatures for Jaccard similarity of ``percent`` per cent or more.

    Sets are banded by size, so that similar sets are in one band or in neighbours; within a
    band similarity bounds the differences by k. The feature domain is hashed into groups, few
    enough differences falling into one of them; a group is hashed into ``parts`` partitions, and
    every choice of ``parts - spare`` of them is a signature: the differences of a group with
    ``spare`` or fewer are outside one of the choices. Similar sets therefore share a signature.

    A choice without any element says nothing and would be shared by unrelated sets. A set
    leaves such choices out if enough of its groups keep elements in every choice (then a group
    with few differences is among these, for any partner); otherwise it gives them too. A pair could be
    lost only if both sets relied on them, and then both give them.
    """

    def __init__(self, percent: int = 75, parts: int = 3, spare: int = 1, seed: int = 1):
        if not 0 < percent <= 100 or not 1 <= spare < parts or spare != 1:
            raise ValueError("percent is 1 to 100, and one part is left out of a choice")
        self.percent, self.parts, self.spare, self.seed = percent, parts, spare, seed
        self._upper = [0, 1]

    def band(self, n: int) -> int:
        while self._upper[-1] < n:
            self._upper.append((self._upper[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self._upper, n))

    def _instance(self, s: np.ndarray, band: int) -> np.ndarray:
        self.band(self._upper[-1] + 1 if band >= len(self._upper) else 1)
        upper = self._upper[band]
        # |A xor B| <= (1 - g) / (1 + g) (|A| + |B|)
        k = (100 - self.percent) * 2 * upper // (100 + self.percent)
        groups = k // (self.spare + 1) + 1
        with np.errstate(over="ignore"):
            place = mix(s ^ mix(np.array([self.seed * 1000 + band], np.uint64)))
            value = mix(s + np.uint64(0x1234567))
        p = self.parts
        cell = (place % np.uint64(groups)).astype(np.int64) * p + ((place >> np.uint64(40)) % np.uint64(p)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cells, starts = np.unique(cell[order], return_index=True)
        sums = np.zeros((groups, p), np.uint64)
        with np.errstate(over="ignore"):
            sums.reshape(-1)[cells] = np.add.reduceat(value[order], starts)
        counts = np.bincount(cell, minlength=groups * p).reshape(groups, p)
        rich = int(((counts > 0).sum(1) > self.spare).sum())
        with np.errstate(over="ignore"):
            left = sums.sum(1, dtype=np.uint64)[:, None] - sums
            names = np.arange(groups * p, dtype=np.uint64).reshape(groups, p) + np.uint64(band << 40)
            sigs = mix(left ^ mix(names * _P + np.uint64(self.seed)))
        if rich * (self.spare + 1) > k:
            return sigs[counts.sum(1)[:, None] > counts]
        return sigs.reshape(-1)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """As the larger set of a pair (its own band), and as the smaller one (the next)."""
        if not len(s):
            return np.empty(0, np.uint64)
        band = self.band(len(s))
        self.band(self._upper[band] + 1)
        return np.unique(np.concatenate([self._instance(s, band), self._instance(s, band + 1)]))


#: Longs of a sketch: 2,048 bits tell unrelated sets of up to some 3,500 elements apart.
SKETCH_LONGS = 32


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """For each of 2,048 hash values, whether an odd number of elements has it, as longs. The sketches of two
    sets differ in no more bits than there are elements in one of the sets only."""
    place = mix(s ^ np.uint64(0x5EED))
    odd = np.bincount((place % np.uint64(SKETCH_LONGS * 64)).astype(np.int64), minlength=SKETCH_LONGS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Exact test on sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
