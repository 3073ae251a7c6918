"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A collection of byte strings is read in strides (of 25 bytes, or 50 where the size allows it): its symbols are
the hashes of a stride's bytes, and the suffix at p goes on at p + stride. After h rounds of refinement suffixes
are in the order of their first h symbols (h * stride bytes), so ``depth`` rounds tell apart all strings of
``depth * stride`` bytes.
"""

from __future__ import annotations

import numpy as np

STRIDE = 25
SHARD_BYTES = 1 << 14
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every ``size`` bytes, from hashes of powers of two."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        level = data.astype(np.uint64) + np.uint64(1)
        power, width, out, at = GOLDEN, 1, None, 0
        while width <= size:
            if size & width:
                part = level[at:at + n]
                out = part.copy() if out is None else spread(out * GOLDEN + part)
                at += width
            if width * 2 <= size:
                level = spread(level[:-width] * power + level[width:])
                power = power * GOLDEN
            width *= 2
    return spread(out)


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _numbered(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, by an order which sorts them."""
    there = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], there[1:] != there[:-1]]))
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    return _numbered(x, np.argsort(x))


def _sorted(x: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0 on: radix passes of 16 bits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    top, bits = int(x.max(initial=0)), 16
    while top >> bits:
        order = order[np.argsort((x >> bits & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        bits += 16
    return order


class Shard:
    """The sorted suffixes of some strings, and their transform."""

    def __init__(self, symbols: np.ndarray, next_: np.ndarray, before: np.ndarray):
        # By 1, 2, 4, ... symbols, to the end of the strings: refinement relies on the full order.
        rank, hop = _ranks(symbols), next_
        while (hop >= 0).any():
            ahead = np.where(hop >= 0, rank[hop] + 1, 0)
            order = _sorted(ahead)
            rank = _numbered(rank * (len(rank) + 2) + ahead, order[_sorted(rank[order])])
            if rank.max() + 1 == len(rank):
                break
            hop = np.where(hop >= 0, hop[hop], -1)
        self.order = _sorted(rank)
        # The symbol before each sorted suffix; -1 where there is none.
        p = before[self.order]
        self.transform = np.where(p >= 0, symbols[p], -1)
        # Suffixes with nothing after them stand before all others and are nobody's predecessor.
        self.empty = int((next_ < 0).sum())


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes (a shard number each) and the block of each: equal
    blocks have a common prefix of ``depth`` symbols.

    Each round moves every suffix to that of its predecessor: stably sorted by the symbol before, the
    order by h symbols becomes that by h + 1. Only shard numbers are moved; a shard's own order is final.
    """
    z = np.repeat(np.arange(len(shards)), [len(s.order) for s in shards])
    block = np.zeros(len(z), np.int64)
    empty = np.repeat(np.arange(len(shards)), [s.empty for s in shards])
    transforms = np.concatenate([s.transform for s in shards])
    for _ in range(depth):
        symbol = np.empty(len(z), np.int64)
        symbol[_sorted(z)] = transforms
        live = np.flatnonzero(symbol >= 0)
        live = live[_sorted(symbol[live])]
        moved, old, sym = z[live], block[live], symbol[live]
        split = np.ones(len(live), bool)
        split[1:] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
        new_z = np.concatenate([empty, moved])
        new_block = np.concatenate([np.zeros(len(empty), np.int64), np.cumsum(split)])
        if np.array_equal(new_z, z) and np.array_equal(new_block, block):
            break
        z, block = new_z, new_block
    return z, block


def repeated_windows(strings: list[bytes], weights: list[int], size: int = 400, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string, a mask of the window starts whose ``size`` bytes are found twice or more; a
    string of weight w counts w times."""
    if size % STRIDE:
        raise ValueError(f"size is a multiple of {STRIDE}")
    stride = STRIDE if size % (2 * STRIDE) else 2 * STRIDE
    depth = size // stride
    # All strings in a row, each with a stride of padding: a suffix is a place, in string ``owner`` at ``offset``.
    lengths = np.array([len(s) for s in strings], np.int64)
    padded = lengths + stride
    starts = np.concatenate([[0], np.cumsum(padded)])
    owner = np.repeat(np.arange(len(strings)), padded)
    offset = np.arange(starts[-1]) - starts[:-1][owner]
    hashes = window_hashes(np.frombuffer((bytes(stride).join(strings) + bytes(2 * stride - 1)), np.uint8), stride)
    # Code 0: fewer bytes left than a stride, down to none.
    whole = np.flatnonzero(offset <= lengths[owner] - stride)
    codes = np.zeros(len(owner), np.int64)
    codes[whole] = _ranks(hashes[whole]) + 1
    next_ = np.where(offset + stride < padded[owner], np.arange(len(owner)) + stride, -1)
    before = np.where(offset >= stride, np.arange(len(owner)) - stride, -1)
    shards, places, i = [], [], 0
    while i < len(strings):
        at, total = i, 0
        while i < len(strings) and (not total or total + len(strings[i]) <= shard_bytes):
            total += int(padded[i])
            i += 1
        own = slice(int(starts[at]), int(starts[i]))
        shard = Shard(codes[own], *(np.where(x[own] >= 0, x[own] - own.start, -1) for x in (next_, before)))
        shards.append(shard)
        places.append(shard.order + own.start)
    windows = np.maximum(lengths - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(windows)])
    mask = np.zeros(first[-1], bool)
    out = [mask[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    if not shards:
        return out
    z, block = merge(shards, depth)
    place = np.empty(len(z), np.int64)
    place[_sorted(z)] = np.concatenate(places)
    string, offset = owner[place], offset[place]
    valid = offset <= lengths[string] - size
    string, offset, block = string[valid], offset[valid], block[valid]
    if not len(block):
        return out
    found = np.bincount(block, weights=np.asarray(weights, float)[string])
    twice = found[block] >= 2
    mask[first[string[twice]] + offset[twice]] = True
    return out
