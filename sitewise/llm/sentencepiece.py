"""SentencePiece encoding and decoding by batched Viterbi.

Method: a text, with blanks turned into the mark U+2581, falls into words, as no piece has a
mark after another character (checked when the model is loaded). The distinct words of a batch
are grouped by length; words of equal length advance together through one Viterbi: the hash of
each substring, from rolling prefix hashes, probes the sorted hashes of the pieces; a vectorised
maximum over the piece lengths gives the best score of each position and its backpointer. Of equal
scores the longest piece wins. A character which no piece covers has the worst piece's score
less 10 and becomes its UTF-8 bytes.

This is the exact best segmentation by the scores in the model file, as SentencePiece defines it
for unigram models. A model of merges keeps merge ranks as scores: its pieces and scores are used in
the same way, which may segment a word otherwise than replaying the merges would. Decoding is
the same for both, and the round trip is exact.

A task holds one Arrow batch and the model, which is of fixed size. No shuffle.

Defined cases: null stays null, an empty text has no tokens; a text's own U+2581 decodes as a
blank, as in SentencePiece; ids outside the vocabulary and special pieces decode to nothing, bytes that are
no UTF-8 to U+FFFD; repeated rows are encoded each; empty tables work; other columns are kept, those named
like an output give way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+\\Z")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SEEN_SHIFT = np.uint64(44)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


@dataclass
class Pieces:
    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: int
    unknown_score: float
    bytes_of: list[bytes]  # what each id decodes to
    byte_ids: np.ndarray  # 256 ids, or empty without byte fallback
    prefix: bool  # a mark before the text
    seen: np.ndarray  # by the upper bits of a hash: whether a piece has these

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], prefix: bool = True) -> Pieces:
        """From (piece, score, type) in order of ids."""
        usable = [(i, p, s) for i, (p, s, t) in enumerate(pieces) if t in (NORMAL, USER)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for _, p, _ in usable):
            raise ValueError("a piece spans words: this vocabulary can't be encoded word by word")
        hashed = np.array([_hash(p) for _, p, _ in usable], np.uint64)
        order = np.argsort(hashed, kind="stable")
        if len(np.unique(hashed)) < len(hashed):
            raise ValueError("two pieces share a hash")
        seen = np.zeros(1 << (64 - int(SEEN_SHIFT)), bool)
        seen[hashed >> SEEN_SHIFT] = True
        byte_ids = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        decoded = [
            bytes([int(p[1:-1], 16)]) if t == BYTE else p.encode() if t in (NORMAL, USER) else b"" for p, _, t in pieces
        ]
        return cls(
            hashed[order], np.array([usable[i][0] for i in order], np.int32),
            np.array([usable[i][2] for i in order]), max(len(p) for _, p, _ in usable),
            next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0),
            min((s for _, s, t in pieces if t == NORMAL), default=0.0) - 10,
            decoded, np.array([byte_ids[b] for b in range(256)], np.int32) if len(byte_ids) == 256 else np.empty(0, np.int32),
            prefix, seen,
        )

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a normaliser of their own are supported")
        return cls.of([(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return _WORDS.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode_words(self, words: list[str], cells: int = 1 << 15) -> dict[str, np.ndarray]:
        """Ids of each distinct word."""
        by_length: dict[int, list[str]] = {}
        for w in dict.fromkeys(words):
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, np.ndarray] = {}
        for length, group in by_length.items():
            step = max(1, cells // length)
            for at in range(0, len(group), step):
                part = group[at:at + step]
                out.update(zip(part, self._viterbi(part, length), strict=True))
        return out

    def _viterbi(self, words: list[str], length: int) -> list[np.ndarray]:
        n, m = len(words), min(self.longest, length)
        codes = _codes("".join(words)).reshape(n, length)
        prefix = np.zeros((n, length + 1), np.uint64)
        power = np.ones(m + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length):
                prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
            for size in range(1, m + 1):
                power[size] = power[size - 1] * _BASE
        # Arrays by size, then position, so that all words of a step are side by side.
        prefix = np.ascontiguousarray(prefix.T)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        found = {size: self._probe(prefix, size, power[size]) for size in range(1, m + 1)}
        for e in range(1, length + 1):
            # From the longest piece down: of equal scores the longest wins.
            for size in range(min(m, e), 0, -1):
                score, ids = found[size]
                total = best[e - size] + score[e - size]
                better = total > best[e]
                np.copyto(best[e], total, where=better)
                np.copyto(piece[e], ids[e - size], where=better)
                back[e][better] = size
        rows = np.arange(n)
        ends = np.full(n, length)
        steps = []
        while (live := ends > 0).any():
            steps.append(np.where(live, piece[ends, rows], -1))
            ends = np.where(live, ends - back[ends, rows], 0)
        path = np.stack(steps[::-1], axis=1)
        used = path >= 0
        bounds = np.concatenate([[0], np.cumsum(used.sum(1))]).tolist()
        flat = path[used]
        out = [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(self.byte_ids):
            for i in np.flatnonzero((path == self.unknown).any(1)).tolist():
                out[i] = self._spelled(words[i], out[i])
        return out

    def _probe(self, prefix: np.ndarray, size: int, power: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the piece of ``size`` characters at each start; -inf and -1 where there is none."""
        with np.errstate(over="ignore"):
            h = (prefix[size:] - prefix[:-size] * power) ^ (np.uint64(size) << np.uint64(58))
        score, ids = np.full(h.shape, -np.inf), np.full(h.shape, -1, np.int32)
        if size == 1:
            score[:], ids[:] = self.unknown_score, self.unknown
        if len(self.keys):
            # Most substrings are no piece: a table of the upper bits tells before the search.
            maybe = self.seen[h >> SEEN_SHIFT]
            probes = h[maybe]
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            hit = self.keys[at] == probes
            maybe[maybe] = hit
            score[maybe], ids[maybe] = self.scores[at[hit]], self.ids[at[hit]]
        return score, ids

    def _spelled(self, word: str, ids: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        for i in ids.tolist():
            if i == self.unknown:
                parts.append(self.byte_ids[np.frombuffer(word[at].encode("utf-8", "replace"), np.uint8)])
                at += 1
            else:
                parts.append(np.array([i], np.int32))
                at += len(self.bytes_of[i].decode())
        return np.concatenate(parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        number: dict[str, int] = {}
        counts: list[int] = []

        def numbered():
            # A text's words go when they have their numbers.
            for t in texts:
                words = self.words(t or "")
                counts.append(len(words))
                for w in words:
                    yield number.setdefault(w, len(number))

        which = np.fromiter(numbered(), np.int64)
        table = self.encode_words(list(number))
        found = [table[w] for w in number]
        # One gather for all texts: the ids of each word in turn.
        sizes = np.array([len(x) for x in found], np.int64)
        first = np.cumsum(sizes) - sizes
        known = np.concatenate([np.empty(0, np.int32), *found]).astype(np.int32)
        own = sizes[which]
        ends = np.cumsum(own)
        flat = known[np.repeat(first[which] - ends + own, own) + np.arange(own.sum())]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        return [
            None if t is None else flat[a:b] for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)
        ]

    def decode(self, ids) -> str:
        size = len(self.bytes_of)
        text = b"".join([self.bytes_of[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _hash(piece: str) -> int:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in _codes(piece):
            h = h * _BASE + c
    return int(h ^ (np.uint64(len(piece)) << np.uint64(58)))


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if v is None else len(v) for v in values]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *[v for v in values if v is not None]]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat), mask=pa.array([v is None for v in values]) if len(values) else None
    )


def _slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000):
    """Parts of a batch with about so many bytes, at least a row each: long texts stay few."""
    start = total = 0
    lengths = [len(x.as_buffer()) if x.is_valid and hasattr(x, "as_buffer") else 0 for x in batch.column(column)]
    for i, size in enumerate(lengths):
        if total and total + size > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _with_ids(batches, pieces: Pieces, text: str, ids: str):
    for whole in batches:
        for batch in _slices(whole, text):
            column = _lists(pieces.encode(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])


def _with_text(batches, pieces: Pieces, ids: str, text: str):
    for batch in batches:
        lists = batch.column(ids)
        out = [pieces.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in lists]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])


def _schema(kept: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, kind in fields.items())])


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kept = docs.drop(ids)
    return kept.mapInArrow(lambda batches: _with_ids(batches, shared.value, text, ids), _schema(kept, **{ids: T.ArrayType(T.IntegerType())}))


def decode(tokens: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids``."""
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    kept = tokens.drop(text)
    return kept.mapInArrow(lambda batches: _with_text(batches, shared.value, ids, text), _schema(kept, **{text: T.StringType()}))


def with_round_trip(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``docs`` with ids, n_tokens and exact (the ids decode to the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kept = docs.drop("ids", "_decoded")

    def run(batches):
        # encode and decode in one process: as two steps of a plan each task had two, which Spark keeps for later stages.
        return _with_text(_with_ids(batches, shared.value, text, "ids"), shared.value, "ids", "_decoded")

    done = kept.mapInArrow(run, _schema(kept, ids=T.ArrayType(T.IntegerType()), _decoded=T.StringType()))
    return done.select(
        *[c for c in done.columns if c not in ("_decoded", "n_tokens", "exact")],
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.col(text), F.lit("")).eqNullSafe(F.coalesce("_decoded", F.lit(""))).alias("exact"),
    )
