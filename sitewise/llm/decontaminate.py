"""Benchmark decontamination over a positional inverted index of the training texts.

Method: the places of training terms are stored as postings (term, document, position); a
phrase is matched by intersecting the lists of its terms, each shifted by the term's offset in
the phrase, from the rarest term on. Proximity matches ask for the same terms in any order
within a span.

The index is sharded by document: a row holds a document's posting lists, so the lists of a
phrase are intersected where they are and none is ever shuffled. It holds the terms of the test items only
(nothing else is ever asked for), and of these only in documents which have the rarest term of at
least one phrase: others can hold no phrase. It is written to the shared folder once, then
searched by one block of phrases after the other, each broadcast as packed numbers: a block is a
residue of the phrase's hash and has about ``max_phrases`` phrases. The terms are broadcast as well; should the items have
more than ``max_terms`` distinct ones, the phrases are first parted until the terms of each part are
no more, and each part has an index of its own. So neither number is limited.

Shuffles: counts per term; matches. Whole texts are never moved.

Defined cases: null and empty texts and items have no words and match nothing; an item of fewer
words than the window is one window; ids may be null or repeated, each row being a document of
its own (repeats share an answer); null item ids match but are left out of item lists; empty tables work.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import TERM_GAP, ascii_lower, row_key, split_words, term_bytes
from sitewise.sources.scratch import stored

CHUNK = 256  # documents indexed at a time
CACHE = 10_000  # rarest terms whose phrases a task keeps unpacked


def phrases_of(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item_ids): distinct windows of the items as arrays of terms."""
    words = items.select(
        F.col(item_id).cast("string").alias("item"),
        F.explode(F.array(split_words(ascii_lower(F.coalesce(text, F.lit(""))), TERM_GAP))).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("phrase")).groupBy(
        "phrase"
    ).agg(F.collect_set("item").alias("item_ids"))


def _term_counts(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    words = docs.select(F.explode(split_words(ascii_lower(F.coalesce(text, F.lit(""))), TERM_GAP)).alias("term"))
    return words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, numbers: dict[bytes, int], rarest: set[int], text: str, doc_id: str) -> DataFrame:
    """One row per document, stored: its key, id, number of words, and the posting lists of the
    terms in ``numbers``: terms (their numbers), ends (of each list), places (the lists, one after the
    other). No lists unless it has a term in ``rarest``."""
    known = docs.sparkSession.sparkContext.broadcast((numbers, rarest))

    def described(body):
        numbers, rarest = known.value
        words = term_bytes(body)
        if rarest.isdisjoint(map(numbers.get, words)):
            return len(words), [], [], []
        places: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if (number := numbers.get(word)) is not None:
                places.setdefault(number, []).append(at)
        return (
            len(words), np.fromiter(places, np.int32, len(places)), np.cumsum([len(x) for x in places.values()], dtype=np.int32),
            np.fromiter(itertools.chain.from_iterable(places.values()), np.int32),
        )

    def rows(batches):
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.iloc[start:start + CHUNK]
                found = [described(body) for body in part["t"]]
                yield pd.DataFrame({
                    "k1": part["k1"], "k2": part["k2"], "id": part["id"],
                    **{c: pd.Series([x[i] for x in found], part.index) for i, c in enumerate(("n_words", "terms", "ends", "places"))},
                })

    kind = docs.schema[doc_id].dataType.simpleString()
    # As text: a nullable column of numbers would come back as doubles.
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t"))
    schema = "k1 long, k2 long, id string, n_words long, terms array<int>, ends array<int>, places array<int>"
    return stored(keyed.mapInPandas(rows, schema).withColumn("id", F.col("id").cast(kind)), "positional-index")


def _residue(phrases: DataFrame, count: int, seed: int) -> Column:
    """A phrase's part or block out of ``count``; different seeds divide independently."""
    return F.pmod(F.xxhash64(F.lit(seed), "phrase_id"), F.lit(count))


def _parts(phrases: DataFrame, n_phrases: int, max_terms: int) -> list[DataFrame]:
    """``phrases`` in parts of at most ``max_terms`` distinct terms (or of one phrase)."""
    if phrases.select(F.explode("phrase").alias("term")).distinct().count() <= max_terms:
        return [phrases]
    count = 1
    while count < n_phrases:
        count *= 2
        flat = phrases.select(_residue(phrases, count, 1).alias("part"), F.explode("phrase").alias("term")).distinct()
        if flat.groupBy("part").count().agg(F.max("count")).first()[0] <= max_terms:
            break
    return [phrases.where(_residue(phrases, count, 1) == i) for i in range(count)]


class _Block:
    """Phrases by their rarest term, packed; an order is the (term, offset) of a phrase from the
    rarest term on. Terms are numbered by rarity."""

    def __init__(self, phrases: pa.Table, terms: pa.Array):
        lists = phrases["phrase"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        offsets = (np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = np.lexsort((offsets, numbers, owner))
        self.terms, self.offsets = numbers[order], offsets[order]
        self.ends = np.cumsum(sizes)
        self.ids = phrases["phrase_id"].to_numpy()
        first = self.terms[self.ends - sizes]
        self.by_first = np.argsort(first, kind="stable").astype(np.int32)
        rarest, starts = np.unique(first[self.by_first], return_index=True)
        self.spans = dict(zip(rarest.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(first)]), strict=True))

    def asked(self, term: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """(phrase_id, order) of the phrases whose rarest term this is."""
        out = []
        for i in self.by_first[slice(*self.spans[term])].tolist():
            own = slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
            out.append((int(self.ids[i]), list(zip(self.terms[own].tolist(), self.offsets[own].tolist(), strict=True))))
        return out


def _phrases(items: DataFrame, window: int) -> DataFrame:
    return stored(phrases_of(items, window).withColumn("phrase_id", F.xxhash64("phrase")), "test-phrases")


def _prepare(docs, phrases, text, doc_id, max_terms, max_phrases):
    """For each part of the phrases: its index, and a function which gives its blocks in turn."""
    total = phrases.count()
    for part in _parts(phrases, total, max_terms):
        terms = stored(part.select(F.explode("phrase").alias("term")).distinct(), "test-terms")
        counts = stored(_term_counts(docs, terms, text), "term-counts")
        known = terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
        # Terms found nowhere come first, and no document will have them.
        by_rarity = known.sort_by([("n", "ascending"), ("term", "ascending")])["term"].combine_chunks()
        numbers = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(by_rarity.to_pylist())}
        count = max(1, -(-part.count() // max_phrases))

        def blocks(part=part, by_rarity=by_rarity, count=count):
            for i in range(count):
                yield _Block(part.where(_residue(part, count, 2) == i).select("phrase_id", "phrase").toArrow(), by_rarity)

        rarest = set().union(*(block.spans for block in blocks()))
        yield build_index(docs, numbers, rarest, text, doc_id), blocks


class _Lists(dict):
    """A document's posting lists by term, as sets made when first asked for; empty for other terms."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, places: np.ndarray):
        self.spans = dict(zip(terms.tolist(), zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), strict=True))
        self.places = places

    def __missing__(self, term: int) -> frozenset[int]:
        start, end = self.spans.get(term, (0, 0))
        self[term] = own = frozenset(self.places[start:end].tolist())
        return own


def _search(index: DataFrame, block: _Block, match, schema: str) -> DataFrame:
    """Run ``match(lists, phrase order)`` for every phrase of a block whose rarest term a document has."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def rows(batches):
        asked = functools.lru_cache(CACHE)(shared.value.asked)
        for batch in batches:
            out = []
            for k1, k2, terms, ends, places in zip(*(batch[c] for c in ("k1", "k2", "terms", "ends", "places")), strict=True):
                lists = _Lists(terms, ends, places)
                for term in lists.spans.keys() & shared.value.spans.keys():
                    for phrase_id, order in asked(term):
                        out += [(k1, k2, phrase_id, *found) for found in match(lists, order)]
            yield pd.DataFrame(out, columns=["k1", "k2", "phrase_id", *(c.split()[0] for c in schema.split(", "))])

    full = f"k1 long, k2 long, phrase_id long, {schema}"
    found = index.where(F.size("terms") > 0).select("k1", "k2", "terms", "ends", "places").mapInPandas(rows, full)
    found = stored(found, "phrase-matches")
    shared.unpersist()
    return found


def _exact(lists: dict, order: list) -> list[tuple[int, int]]:
    """(len, start): offset-adjusted lists intersected from the rarest term on."""
    term, offset = order[0]
    starts = {at - offset for at in lists[term] if at >= offset}
    for term, offset in order[1:]:
        if not starts:
            return []
        own = lists[term]
        starts = {s for s in starts if s + offset in own}
    return [(len(order), s) for s in starts]


def _all_matches(docs, phrases, match, schema, text, doc_id, max_terms, max_phrases) -> tuple[DataFrame, DataFrame]:
    """The matches of all parts and blocks, and an index, which has a row for every document."""
    found, index = [], None
    for own, blocks in _prepare(docs, phrases, text, doc_id, max_terms, max_phrases):
        index = own if index is None else index
        found += [_search(own, block, match, schema) for block in blocks()]
    return functools.reduce(DataFrame.unionByName, found), index


def proximity_matches(
    docs: DataFrame, items: DataFrame, window: int = 10, span: int = 20, text: str = "text",
    doc_id: str = "doc_id", max_terms: int = 1_000_000, max_phrases: int = 500_000,
) -> DataFrame:
    """(doc_id, phrase, item_ids): phrases all of whose distinct terms occur, in any order, within
    ``span`` words of one occurrence of their rarest term."""

    def near(lists, order):
        for at in sorted(lists[order[0][0]]):
            if all(any(at + d in lists[t] for d in range(-span, span + 1)) for t in {t for t, _ in order}):
                return [(at,)]
        return []

    phrases = _phrases(items, window)
    found, index = _all_matches(docs, phrases, near, "at int", text, doc_id, max_terms, max_phrases)
    return found.select("k1", "k2", "phrase_id").distinct().join(phrases, "phrase_id").join(
        index.select("k1", "k2", F.col("id").alias(doc_id)), ["k1", "k2"]
    ).select(doc_id, "phrase", "item_ids")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id",
    max_terms: int = 1_000_000, max_phrases: int = 500_000,
) -> DataFrame:
    """One row per document: k1, k2 (its row key), doc_id, n_words, n_hit (words inside any
    occurrence), items (ids, sorted as strings) and contaminated."""
    phrases = _phrases(items, window)
    matches, index = _all_matches(docs, phrases, _exact, "len int, start int", text, doc_id, max_terms, max_phrases)
    hit = matches.select(
        "k1", "k2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("at")
    ).distinct().groupBy("k1", "k2").agg(F.count("*").alias("hit"))
    named = matches.select("k1", "k2", "phrase_id").distinct().join(phrases, "phrase_id").select(
        "k1", "k2", F.explode("item_ids").alias("item")
    ).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return index.drop("terms", "ends", "places").join(hit, ["k1", "k2"], "left").join(named, ["k1", "k2"], "left").select(
        "k1", "k2", F.col("id").alias(doc_id), "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("hit").isNotNull().alias("contaminated"),
    )
