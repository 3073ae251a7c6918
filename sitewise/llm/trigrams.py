"""Trigram queries of regular expressions, and trigram postings of a block of texts.

A query is ``True`` (every text may match), a trigram (three bytes), or ``(ALL, parts)`` / ``(ANY, parts)``.
A text which a pattern matches always satisfies the pattern's query; the reverse is for the pattern to tell.
Trigrams are of UTF-8 bytes with A-Z lower-cased, in texts and queries alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np

ALL, ANY = "all", "any"
#: Most strings a part of a pattern is spelled out to, and most characters of a class.
MOST_STRINGS, MOST_CHARS = 64, 8
#: Bytes of a text looked at in one step.
PIECE = 1 << 22


def trigram_query(pattern: str, flags: int = 0):
    """The query which every match's text satisfies."""
    return _needs(list(parser.parse(pattern, flags)))


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def fold(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _all(parts: Iterable) -> object:
    left = {p for p in parts if p is not True}
    return True if not left else left.pop() if len(left) == 1 else (ALL, frozenset(left))


def _any(parts: Iterable) -> object:
    parts = set(parts)
    return True if True in parts or not parts else parts.pop() if len(parts) == 1 else (ANY, frozenset(parts))


def _spelled(strings: set[str]) -> object:
    """One of these strings is in the text."""
    folded = {fold(s) for s in strings}
    return _any(_all({s[i:i + 3] for i in range(len(s) - 2)}) if len(s) > 2 else True for s in folded)


def _needs(parts: list) -> object:
    """The query of a sequence: strings spelled out as far as they go, the rest by itself."""
    runs, needs = {""}, []
    for part in parts:
        strings = _strings(part)
        if strings is not None and len(runs) * len(strings) <= MOST_STRINGS:
            runs = {a + b for a, b in product(runs, strings)}
            continue
        needs.append(_spelled(runs))
        if strings is None:
            needs.append(_inside(part))
        runs = strings or {""}
    return _all([*needs, _spelled(runs)])


def _inside(part) -> object:
    """The query of a part with no short list of strings."""
    kind, value = part
    if kind is op.SUBPATTERN:
        return _needs(list(value[3]))
    if kind is op.ATOMIC_GROUP:
        return _needs(list(value))
    if kind is op.BRANCH:
        return _any(_needs(list(branch)) for branch in value[1])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
        return _needs(list(value[2]))
    return True


def _strings(part) -> set[str] | None:
    """All strings which a part can match, if they are few."""
    kind, value = part
    if kind is op.LITERAL:
        return {chr(value)}
    if kind is op.AT:
        return {""}
    if kind is op.IN:
        chars = set()
        for what, x in value:
            if what is op.LITERAL:
                chars.add(chr(x))
            elif what is op.RANGE and x[1] - x[0] < MOST_CHARS:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MOST_CHARS else None
    if kind is op.SUBPATTERN:
        return _sequence(value[3]) if not value[1] else None
    if kind is op.BRANCH:
        found = [_sequence(branch) for branch in value[1]]
        return set().union(*found) if None not in found and sum(map(len, found)) <= MOST_STRINGS else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[1] <= 4:
        once = _sequence(value[2])
        if once is None or len(once) ** value[1] > MOST_STRINGS:
            return None
        return {"".join(s) for times in range(value[0], value[1] + 1) for s in product(once, repeat=times)}
    return None


def _sequence(parts) -> set[str] | None:
    out = {""}
    for part in parts:
        strings = _strings(part)
        if strings is None or len(out) * len(strings) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, strings)}
    return out


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 256 texts: the trigrams in order, where each one's texts begin, and the texts' numbers."""
    joined = b"".join(texts).lower()
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])
    raw = np.frombuffer(joined, dtype=np.uint8)
    found = []
    for at in range(0, max(len(raw) - 2, 0), PIECE):
        b, own = raw[at:at + PIECE + 2].astype(np.uint32), owner[at:at + PIECE + 2]
        keys = (b[:-2] << 24) | (b[1:-1] << 16) | (b[2:] << 8) | own[:-2]
        found.append(np.unique(keys[own[:-2] == own[2:]]))
    keys = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.uint32)
    grams = keys >> 8
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[starts].astype(np.uint32), np.append(starts, len(grams)).astype(np.uint32), (keys & 255).astype(np.uint8)


class Posted:
    """Postings of a block, answering queries."""

    def __init__(self, grams: np.ndarray, starts: np.ndarray, numbers: np.ndarray, count: int):
        self.grams, self.starts, self.numbers, self.count = grams, starts, numbers, count
        self.seen: dict[bytes, np.ndarray] = {}

    def texts(self, query) -> np.ndarray:
        """A flag for each text: whether it may match."""
        if query is True:
            return np.ones(self.count, dtype=bool)
        if isinstance(query, bytes):
            if query not in self.seen:
                self.seen[query] = self._of(_code(query))
            return self.seen[query]
        combine = np.logical_and if query[0] == ALL else np.logical_or
        return combine.reduce([self.texts(part) for part in query[1]])

    def _of(self, code: int) -> np.ndarray:
        flags = np.zeros(self.count, dtype=bool)
        at = int(np.searchsorted(self.grams, code))
        if at < len(self.grams) and self.grams[at] == code:
            flags[self.numbers[self.starts[at]:self.starts[at + 1]]] = True
        return flags


def compiled(pattern: str, any_case: bool) -> re.Pattern:
    """ASCII classes and cases only, so that no other letter counts as one of the pattern's."""
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if any_case else 0))
