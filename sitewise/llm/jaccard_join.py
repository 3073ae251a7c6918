"""N-gram Jaccard join of word shingle sets, with PartEnum signatures.

Method: documents with equal sets are one class. Classes whose sets are similar enough share a
PartEnum signature (``signatures.PartEnum``); every pair which shares one is tested exactly.

Two exact tests come first, as signatures alone are shared by unrelated documents with a common
passage. Shingles have one global order: by the number of times they are found (see
:mod:`sitewise.llm.shared_shingles`), those found often in a sample last. Similar sets share one of their
first n - ceil(0.75 n) + 1 shingles. So classes none of whose first shingles are in another class have no
partner, and the others fall into blocks (connected by common first shingles) which no link crosses. Only
classes in blocks get signatures, and a signature counts inside its block. The order only affects cost: any
order gives blocks which no link crosses, rarest first gives the smallest.

In blocks of at most ``small_block`` classes, by far the most, the buckets are formed inside the
task which has the block. In larger ones signatures are shuffled, and a class is paired with the smallest
members of its buckets, those it meets most often; then, after linking, classes of different components
with a common first shingle are paired, unless sketches of their sets (an exact bound) tell that they are too
different. So large groups of near copies cost a few stars, not all their pairs,
and no link between components is lost.

Shuffles: all shingles once, packed (some 7 bytes each), those found twice once more; texts once, to meet
the classes in blocks; signatures of these. Nothing is broadcast but the frequent shingles, 100,000 at most.

Defined cases: null and empty texts have empty sets, linked with nothing (their component is the
own id); fewer words than a shingle are one shingle; repeated rows are in the same class; rows with
null id take part, their own component is the smallest id of the class that is not null; empty tables work.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import row_key
from sitewise.llm.components import components
from sitewise.llm.shared_shingles import REF_BITS, first_shingles, short_hashes
from sitewise.llm.signatures import SKETCH_LONGS, PartEnum, parity_sketch, set_hash, shingle_sets, similar
from sitewise.sources.scratch import stored

CHUNK = 250  # texts shingled at a time
#: Members of its buckets with which a class of a large block is tested first.
LEADS = 8
#: So many shingles of a block are marked, by which pairs with several common ones are told; 64 to a long.
MARKS = 256


def _chunks(batches, column):
    """Arrow batches a few texts at a time: as Python's strings a whole batch takes twice its memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK).to_pandas()
            yield part, part[column].tolist()


def _in_arrow(run, **fields):
    """For ``mapInArrow``, a function which yields data frames."""
    schema = pa.schema(fields)
    return lambda batches: (pa.RecordBatch.from_pandas(out, schema, preserve_index=False) for out in run(batches))


def frequent_shingles(docs: DataFrame, size: int, text: str, every: int = 16, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Shingles found in ``least`` documents or more of every sixteenth, ``most`` at most."""

    def run(batches):
        for _, texts in _chunks(batches, "t"):
            sets = shingle_sets(texts, size)
            for s in sets:
                yield pd.DataFrame({"s": s.view(np.int64)})

    sample = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0)
    counts = sample.mapInArrow(_in_arrow(run, s=pa.int64()), "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "s").limit(most).select("s").collect()
    return np.sort(np.array([r.s for r in rows], np.int64).view(np.uint64))


def _common(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which shingles are among the frequent ones."""
    if not len(often):
        return np.zeros(len(s), bool)
    return often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s


def _prefix(n: int, percent: int) -> int:
    """So many first shingles of a set of n; similar sets share one of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose sets are similar."""

    # A built-in test: batches of pairs for Python would hold two sets for each of 10,000 rows.
    both = F.size(F.array_intersect("x", "y"))
    alike = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"), F.col("n").alias("na"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"), F.col("n").alias("nb"))
    sized = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b"
    ).where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))).select("a", "b")
    return sized.join(left.drop("na"), "a").join(right.drop("nb"), "b").where(alike).select("a", "b")


def _inside(percent: int, parts: int):
    """Links inside small blocks, which come sorted: a block's buckets are formed in the task."""

    def solve(ids, sets, scheme):
        sigs = [scheme.signatures(s) for s in sets]
        flat = np.concatenate(sigs)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sigs])
        order = np.argsort(flat, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        pairs = set()
        for bucket in np.split(owner[order], edges[1:]):
            if len(bucket) > 1:
                own = bucket.tolist()
                pairs.update((x, y) for i, y in enumerate(own) for x in own[:i])
        return [(ids[x], ids[y]) for x, y in sorted(pairs) if similar(sets[x], sets[y], percent)]

    def run(batches):
        scheme, block, ids, sets = PartEnum(percent, parts), None, [], []
        for batch in batches:
            out = []
            for b, i, raw in zip(batch["block"].tolist(), batch["id"].tolist(), batch["set"], strict=True):
                if b != block:
                    out += solve(ids, sets, scheme) if len(ids) > 1 else []
                    block, ids, sets = b, [], []
                ids.append(i)
                sets.append(raw.view(np.uint64))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(solve(ids, sets, scheme) if len(ids) > 1 else [], columns=["a", "b"], dtype="int64")

    return run


def jaccard_classes(
    docs: DataFrame, percent: int = 75, size: int = 5, parts: int = 3, text: str = "text", doc_id: str = "doc_id",
    small_block: int = 64,
) -> DataFrame:
    """One row per document: k1, k2 (row key), doc_id, n_shingles and component_id (smallest id
    reachable by links of ``percent`` per cent similarity or more)."""
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size, text))

    def describe(batches):
        for part, texts in _chunks(batches, "t"):
            sets = shingle_sets(texts, size)
            names = [set_hash(s) for s in sets]
            common = [_common(s, often.value) for s in sets]
            yield pd.DataFrame({
                "k1": part["k1"], "k2": part["k2"], "id": part["id"], "n": [len(s) for s in sets],
                "s1": [x for x, _ in names], "s2": [y for _, y in names],
                # Shingles which fall together with another when cut short count as frequent.
                "often": [len(s) - short_hashes(s[~c]) for s, c in zip(sets, common)],
                # In the first shingles only of sets which have few others.
                "tail": [s[c][:max(_prefix(len(s), percent) - int((~c).sum()), 0)].view(np.int64) for s, c in zip(sets, common)],
            })

    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t"))
    longs = pa.list_(pa.int64())
    described = _in_arrow(describe, k1=pa.int64(), k2=pa.int64(), id=pa.string(), n=pa.int64(), s1=pa.int64(), s2=pa.int64(), often=pa.int64(), tail=longs)
    schema = "k1 long, k2 long, id string, n long, s1 long, s2 long, often long, tail array<long>"
    rows = stored(keyed.mapInArrow(described, schema).withColumn("id", F.col("id").cast(kind)), "shingle-rows")

    # A class's number: 64 bits of its 128-bit name; another seed should two classes share one.
    full = rows.where("n > 0")
    for seed in range(20):
        number = F.xxhash64(F.lit(seed), "s1", "s2")
        classes = stored(full.groupBy("s1", "s2").agg(
            F.min("id").alias("low"), F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"),
            F.first("often").alias("often"), F.first("tail").alias("tail"),
        ).withColumn("id", number), "shingle-classes")
        if classes.agg(F.count("*") == F.count_distinct("id")).first()[0]:
            break
    else:
        raise RuntimeError("no seed tells all classes apart")

    # Blocks: classes connected by common first shingles, through the short names of their sets.
    short = (F.col("s1").bitwiseAND((1 << REF_BITS) - 1)).alias("ref")
    named = classes.select(short, "id", "n", "often")
    first = first_shingles(keyed.select("t"), named, percent, size, often, _chunks, _common, _in_arrow).unionByName(
        classes.select(short, F.explode("tail").alias("s"))
    )
    first = stored(first, "first-shingles")
    least = first.groupBy("s").agg(F.min("ref").alias("a"), F.max("ref").alias("z")).where("a <> z").drop("z")
    star = first.join(least, "s").where("a <> ref").select("a", F.col("ref").alias("b"))
    # Classes with one short name, if any, are in one block.
    known = components(star).unionByName(named.groupBy("ref").agg(F.count("*").alias("c")).where("c > 1").select(
        F.col("ref").alias("id"), F.col("ref").alias("component")
    )).groupBy("id").agg(F.min("component").alias("block"))
    blocks = named.join(known.withColumnRenamed("id", "ref"), "ref").select("id", "block")
    sizes = blocks.groupBy("block").agg((F.count("*") > small_block).alias("large"))
    wanted = stored(blocks.join(sizes, "block").join(classes.select("id", "k", "n"), "id").select(
        "id", "block", "large", "n", "k.k1", "k.k2"
    ), "shingle-blocks")

    def rebuild(batches):
        for part, texts in _chunks(batches, "t"):
            sets_ = shingle_sets(texts, size)
            yield pd.DataFrame({
                "id": part["id"], "block": part["block"], "large": part["large"], "n": part["n"],
                "set": [s.view(np.int64) for s in sets_],
                "sketch": [parity_sketch(s) if big else None for s, big in zip(sets_, part["large"], strict=True)],
            })

    texts = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))
    sets = stored(
        texts.join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("id", "block", "large", "n", "t").mapInArrow(
            _in_arrow(rebuild, id=pa.int64(), block=pa.int64(), large=pa.bool_(), n=pa.int64(), set=longs, sketch=longs),
            "id long, block long, large boolean, n long, set array<long>, sketch array<long>"
        ), "shingle-sets",
    )

    def sign(batches):
        scheme = PartEnum(percent, parts)
        for batch in batches:
            for i, block, raw in zip(batch["id"], batch["block"], batch["set"], strict=True):
                sigs = scheme.signatures(raw.view(np.uint64)).view(np.int64)
                yield pd.DataFrame({"block": np.full(len(sigs), block), "sig": sigs, "id": np.full(len(sigs), i)})

    near = sets.where("not large").select("block", "id", "set").repartition("block").sortWithinPartitions("block").mapInPandas(
        _inside(percent, parts), "a long, b long"
    )
    signed = sets.where("large").select("id", "block", "set").mapInPandas(sign, "block long, sig long, id long")
    # A bucket's members and its smallest one. Near copies meet a few of these again and again: each class
    # is tested with those it meets most often; whoever is left apart by that is seen to below.
    lead = F.min("id").over(Window.partitionBy("block", "sig"))
    met = signed.withColumn("lead", lead).where("lead <> id").groupBy("id", "lead").agg(F.count("*").alias("times"))
    often_met = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("times"), "lead"))
    pairs = met.withColumn("nth", often_met).where(F.col("nth") <= LEADS).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = stored(_verified(pairs, sets.where("large"), percent).unionByName(near), "links")

    # What that leaves open: a link between two components joins classes with a common first shingle, so all
    # pairs across components are tested where members of two or more have one.
    known = components(links)
    large = wanted.where("large").select("id", "n", "block").join(named.select("ref", "id"), "id")
    placed = first.join(large, "ref").join(known, "id", "left").select("s", "id", "n", "block", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("s").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.first("block").alias("block")
    ).where("low <> high").select("s", "size", "block")
    # Near copies have many first shingles in common, a pair is wanted once: the most frequent ones of a block are
    # marked, and a pair counts at the first of these it has in common (or, having none, at every other).
    nth = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("size"), "s")) - 1
    marks = mixed.withColumn("nth", nth).where(F.col("nth") < MARKS).select("s", "nth")
    open_rows = stored(placed.drop("block").join(mixed.select("s"), "s").join(marks, "s", "left"), "open-rows")
    words = range(MARKS // 64)
    has = open_rows.where("nth is not null").groupBy("id").agg(*(
        F.bit_or(F.expr(f"if(nth div 64 = {k}, shiftleft(1L, cast(nth % 64 as int)), 0L)")).alias(f"m{k}") for k in words
    ))
    # Of a class's marks, those ahead of the row's own shingle.
    ahead = [
        F.expr(f"if(nth is null or nth >= {64 * k + 64}, coalesce(m{k}, 0L), if(nth < {64 * k}, 0L, m{k} & ~shiftleft(-1L, cast(nth % 64 as int))))")
        for k in words
    ]
    sketches = sets.where("large").select("id", *(F.get("sketch", F.lit(i)).alias(f"b{i}") for i in range(SKETCH_LONGS)))
    rest = stored(open_rows.join(has, "id", "left").join(sketches, "id").select(
        "s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"),
        *(a.alias(f"eb{k}") for k, a in enumerate(ahead)), *(f"b{i}" for i in range(SKETCH_LONGS))
    ), "open-buckets")
    others = rest.withColumnsRenamed({"b": "a", "nb": "na", "cb": "ca", **{f"eb{k}": f"ea{k}" for k in words}, **{f"b{i}": f"a{i}" for i in range(SKETCH_LONGS)}})
    sized = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    # Every shingle in one set only turns one bit at most, so sets further apart than this are no link.
    turned = reduce(Column.__add__, (F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH_LONGS)))
    near_by = (100 + percent) * turned <= (100 - percent) * (F.col("na") + F.col("nb"))
    unmet = reduce(Column.__and__, (F.col(f"ea{k}").bitwiseAND(F.col(f"eb{k}")) == 0 for k in words))
    open_ = others.join(rest, "s").where(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized & unmet & near_by
    ).select("a", "b")
    # Shingles of classes with one short name, if any, count as one class's.
    twins = large.select("ref", F.col("id").alias("a")).join(large.select("ref", F.col("id").alias("b")), "ref").where("a < b")
    open_ = open_.unionByName(twins.select("a", "b")).distinct()
    links = links.unionByName(stored(_verified(open_, sets.where("large"), percent), "links"))

    linked = components(links)
    low = linked.join(classes.select("id", "low"), "id")
    low = low.join(low.groupBy("component").agg(F.min("low").alias("reach")), "component")
    reach = classes.select("s1", "s2", "id", "low").join(low.select("id", "reach"), "id", "left").select(
        "s1", "s2", F.coalesce("reach", "low").alias("reach")
    )
    # n keeps the empty sets, which are all equal, from one class.
    return rows.join(reach.withColumn("filled", F.lit(True)), (rows.s1 == reach.s1) & (rows.s2 == reach.s2) & (rows.n > 0), "left").select(
        "k1", "k2", F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("filled"), F.col("reach")).otherwise(F.col("id")).alias("component_id"),
    )
