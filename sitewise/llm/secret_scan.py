"""Secret scan over a trigram inverted index.

Method: the documents of a task are indexed in shards of up to 256 documents or 4 MB: for every trigram
of their bytes (A-Z lower-cased) the documents which have it. Each rule's regular expression yields a
Boolean query over trigrams which every text with a match satisfies (:mod:`sitewise.llm.trigrams`); the
postings are intersected and united by it, and only the candidates are searched by the expression itself.
Rules without a mandatory trigram (runs of hexadecimal digits) search every text.

The index is a table, one row per shard, which :func:`trigram_index` gives and :func:`find_secrets` reads,
so that one index serves many rule sets. :func:`scan_secrets` does both in one task, shard by shard:
no exchange, nothing written, and memory for one shard beside the batch that Spark sends. A text is always
searched whole; one of over 4 MB is a shard of its own, indexed piece by piece.

Matches are leftmost and do not overlap within a rule; a match whose secret is too short is dropped after
the search, and the search goes on behind it. Spans of different rules may overlap, all are kept.

Defined cases: null and empty texts have no secret; spans count code points, end exclusive; equal rows
are searched each; an empty table gives an empty table; other columns are kept, those named like an output
give way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitewise.llm.trigrams import Posted, compiled, postings, trigram_query

SHARD_TEXTS, SHARD_BYTES = 256, 1 << 22


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds of our own. Loops ahead of a literal are bounded, so that no text takes square time.
RULES = BASE + (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"\bgithub_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"\bpypi-[A-Za-z0-9_-]{50,}"),
    Rule("huggingface", r"\bhf_[A-Za-z0-9]{30,}"),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,300}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"\bbearer\x20{1,8}[A-Za-z0-9._~+/-]{20,}", any_case=True),
    Rule("account_key", r"\bAccountKey=[A-Za-z0-9+/]{40,}"),
    Rule("url_login", r"\b[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\x00-\x20/?#:@]{1,100}:[^\x00-\x20/?#@]{1,200}@"),
    # Only one mandatory letter ahead of the digits: no trigram, every text is searched.
    Rule("twilio", r"\b(?:AC|SK)[0-9a-f]{32}\b"),
)
OUTPUTS = ("secrets", "rules_tested")
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _kept(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in docs.columns if c.lower() not in OUTPUTS))


def scan_secrets(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns with ``secrets``, the spans (kind, start, end) by start and then by the order of the
    rules, and ``rules_tested``, the number of expressions the text was searched by."""
    docs, search = _kept(docs), _Search(text, rules)
    return docs.mapInArrow(lambda batches: search.run(_shards(batches, text)), _found_schema(docs.schema))


def trigram_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per shard: its rows (``docs``), and as packed numbers its ``trigrams`` in order, where the
    texts of each begin (``starts``) and their numbers in the shard (``numbers``)."""
    docs = _kept(docs)
    binary = [T.StructField(n, T.BinaryType()) for n in ("trigrams", "starts", "numbers")]
    schema = T.StructType([T.StructField("docs", T.ArrayType(docs.schema)), *binary])
    return docs.mapInArrow(lambda batches: _shards(batches, text), schema)


def find_secrets(index: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """What :func:`scan_secrets` gives, from a table of :func:`trigram_index`."""
    search = _Search(text, rules)
    return index.mapInArrow(search.run, _found_schema(index.schema["docs"].dataType.elementType))


def _found_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("secrets", SPANS), T.StructField("rules_tested", T.IntegerType())])


def _shards(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else []
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, int(sizes[begin])
            while end < len(texts) and end - begin < SHARD_TEXTS and size + sizes[end] <= SHARD_BYTES:
                size, end = size + int(sizes[end]), end + 1
            packed = postings([t or b"" for t in texts.slice(begin, end - begin).to_pylist()])
            rows = pa.concat_arrays([pa.StructArray.from_arrays(batch.slice(begin, end - begin).columns, fields=list(batch.schema))])
            listed = pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [listed, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["docs", "trigrams", "starts", "numbers"]
            )
            begin = end


class _Search:
    """Queries and expressions of a rule set; answers shards."""

    def __init__(self, text: str, rules: Sequence[Rule]):
        self.text, self.rules = text, tuple(rules)
        self.queries = [trigram_query(r.pattern) for r in self.rules]

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [compiled(r.pattern, r.any_case) for r in self.rules]
        for batch in batches:
            for i in range(len(batch)):
                shard = batch.slice(i, 1)
                docs = shard.column(0).flatten()
                packed = [np.frombuffer(shard.column(k)[0].as_py(), dtype=kind) for k, kind in ((1, np.uint32), (2, np.uint32), (3, np.uint8))]
                yield self._answer(docs, Posted(*packed, len(docs)), patterns)

    def _answer(self, docs: pa.StructArray, posted: Posted, patterns: list) -> pa.RecordBatch:
        may = np.stack([posted.texts(q) for q in self.queries]) if self.queries else np.zeros((0, len(docs)), bool)
        texts = docs.field(docs.type.get_field_index(self.text))
        spans: list[list] = [[] for _ in range(len(docs))]
        for n in np.flatnonzero(may.any(axis=0)):
            value = texts[int(n)].as_py()
            if value:
                spans[n] = self._spans(value, np.flatnonzero(may[:, n]), patterns)
        columns = [docs.field(k) for k in range(docs.type.num_fields)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(spans, _SPANS), pa.array(may.sum(axis=0).astype(np.int32))],
            [*(docs.type.field(k).name for k in range(docs.type.num_fields)), *OUTPUTS],
        )

    def _spans(self, value: str, tested: np.ndarray, patterns: list) -> list[dict]:
        found = []
        for k in tested:
            rule = self.rules[k]
            found += [
                (m.start(), k, m.end()) for m in patterns[k].finditer(value) if m.end(rule.group) - m.start(rule.group) >= rule.least
            ]
        return [{"kind": self.rules[k].kind, "start": start, "end": end} for start, k, end in sorted(found)]
