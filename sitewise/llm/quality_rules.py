"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the corpus.

Method: words and word pairs are hashed into ``buckets`` bins; one multinomial is counted over
the trusted target, one over the whole raw corpus; a document's score is the sum over its
n-grams of log(p_target / p_corpus), divided by their number. A document is kept when it passes
the base rules and its score is at least ``threshold``: the same text gets the same answer
whatever the order or partitioning. Both multinomials are counted over all documents, with
``smoothing`` added to each bin. Built-in columns only.

Shuffles: the labelled documents once, to meet their labels (others are dropped by a Bloom filter of
the ids where they are read, but for one in a hundred); counts per bin. The weights are
``buckets`` doubles, whatever the input; they reach the tasks as one scalar.

Defined cases: null and empty texts have no words, fail the base rules and score 0; ids which
are null never match a label; repeated rows are judged each; empty tables give empty tables;
other columns are kept, those named like an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import WHITE, WORD_GAP, split_words
from sitewise.operators.bloom import may_match
from sitewise.sources.scratch import stored

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>"
OUTPUTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept",
)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column which is worked out once, however often it is used: it takes the way through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _hashed(df: DataFrame, words: str = "w") -> DataFrame:
    """Add ``h``, the hashes of the words, and ``pairs``, those of each two neighbours."""
    out = _held(df, "h", F.transform(words, lambda w: F.xxhash64(w)))
    return _held(out, "pairs", _joined_next("h", "h"))


def _joined_next(left: str, hashes: str, ahead: int = 1) -> Column:
    """Hash of each element of ``left`` with the word hash ``ahead`` places on; as many as there are such."""
    n = F.greatest(F.size(hashes) - ahead, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(hashes, F.lit(ahead + 1), n), lambda a, b: F.xxhash64(a, b))


def _bin(value: Column, buckets: int) -> Column:
    """Hash to bin; for a power of two the last bits, which is the same and cheaper."""
    return value.bitwiseAND(F.lit(buckets - 1)) if buckets & (buckets - 1) == 0 else F.pmod(value, F.lit(buckets))


def gram_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bin, n): n-grams of each bin over all documents."""
    words = _held(docs.select(F.col(text).alias("t")), "w", split_words(F.coalesce("t", F.lit("")), WORD_GAP))
    hashed = _hashed(words.where(F.size("w") > 0).select("w"))
    grams = hashed.select(F.explode(F.concat("h", "pairs")).alias("g"))
    return grams.select(_bin(F.col("g"), buckets).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def bin_weights(target: DataFrame, corpus: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """One row with ``buckets`` log ratios, in the order of the bins; in whole thousandths, so
    that sums do not depend on the order of adding."""
    both = (
        target.withColumn("t", F.col("n")).withColumn("c", F.lit(0).cast("long"))
        .unionByName(corpus.withColumn("t", F.lit(0).cast("long")).withColumn("c", F.col("n")))
        .unionByName(corpus.sparkSession.range(buckets).select(
            F.col("id").alias("bin"), *[F.lit(0).cast("long").alias(c) for c in ("n", "t", "c")]
        ))
        .groupBy("bin").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    )
    # One row of bounded length: a bin each.
    row = both.agg(
        F.array_sort(F.collect_list(F.struct("bin", "t", "c"))).alias("bins"), F.sum("t").alias("ts"), F.sum("c").alias("cs")
    )
    ratio = lambda b: (
        F.log((b["t"] + smoothing) / (F.col("ts") + smoothing * buckets))
        - F.log((b["c"] + smoothing) / (F.col("cs") + smoothing * buckets))
    )
    whole = lambda b: F.round(1000 * ratio(b)).cast("int")
    return row.select(F.transform("bins", whole).alias("weights"))


def judge_quality(
    docs: DataFrame, trusted: DataFrame, threshold: float = -0.2, buckets: int = BUCKETS,
    smoothing: float = 1.0, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` with the base counts, base_failed, score and kept.

    ``trusted`` has the ``doc_id`` of each document of the trusted target.
    """
    ids = trusted.select(F.col(doc_id).alias("trusted_id")).where("trusted_id is not null").distinct()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # A Bloom filter of the ids drops most other texts where they are read; the join is merged at every
    # size, as a list of ids grows with the corpus.
    ids = stored(ids, "trusted-ids")
    near = may_match(texts, ids.withColumnRenamed("trusted_id", "id"), ["id"])
    # Inner, as the ids are distinct: Spark would move a semi-join below the filter.
    target = near.join(ids.hint("merge"), F.col("id") == F.col("trusted_id")).select("text")
    weights = stored(
        bin_weights(gram_counts(target, buckets), gram_counts(texts, buckets), buckets, smoothing), "gram-weights"
    )

    t = docs.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("t"))
    w = t.select("row", "t", F.explode(F.array(split_words(F.col("t"), WORD_GAP))).alias("w"))
    w = w.withColumn("n", F.size("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    w = w.select("*", F.explode(F.array(lines)).alias("lines"))

    # Windows of three words found twice. Few texts have two windows of one hash; in these each window is
    # one long: its hash above, its place in the last 28 bits (more than the words of the longest string);
    # sorted, equal hashes are neighbours. These candidates are then compared by the words themselves.
    place = 28
    w = _held(_hashed(w), "windows", _joined_next("pairs", "h", 2))
    coded = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.transform("windows", lambda x, i: F.shiftleft(x, place).bitwiseOR(i.cast("long"))),
    ).otherwise(F.array().cast("array<long>"))
    w = _held(w, "codes", F.sort_array(coded)).drop("windows")
    top = lambda c: F.shiftright(c, place)
    mask = (1 << place) - 1
    near = F.filter("codes", lambda c, i: (
        F.coalesce(top(F.get("codes", i + 1)) == top(c), F.lit(False))
        | F.coalesce(top(F.get("codes", i - 1)) == top(c), F.lit(False))
    ))
    w = w.select("*", F.explode(F.array(near)).alias("near")).drop("codes")
    at = lambda c: c.bitwiseAND(F.lit(mask)).cast("int")
    spelled = F.array_sort(F.transform("near", lambda c: F.struct(
        F.concat_ws(" ", F.get("w", at(c)), F.get("w", at(c) + 1), F.get("w", at(c) + 2)).alias("s"), at(c).alias("p")
    )))
    w = w.select("*", F.explode(F.array(spelled)).alias("spelled")).drop("near")
    twice = F.filter("spelled", lambda x, i: (
        F.coalesce(F.get("spelled", i + 1)["s"] == x["s"], F.lit(False))
        | F.coalesce(F.get("spelled", i - 1)["s"] == x["s"], F.lit(False))
    ))
    w = w.select("*", F.explode(F.array(F.sort_array(F.transform(twice, lambda x: x["p"])))).alias("places")).drop("spelled")
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda acc, x: acc + x,
    )

    # ``buckets`` whole numbers, as one constant of the plan.
    weight = F.split(F.lit(",".join(map(str, weights.first()["weights"]))), ",").cast("array<int>")
    added = lambda acc, g: acc + F.get(weight, _bin(g, buckets).cast("int"))
    total = F.aggregate("pairs", F.aggregate("h", F.lit(0).cast("long"), added), added)
    w = w.select(
        "row", "n", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]++", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.when(F.col("n") > 0, total / 1000 / (2 * F.col("n") - 1)).otherwise(0.0).alias("raw"),
    ).select("*", F.explode(F.array(F.round("raw", 6))).alias("score"))
    failed = (F.col("n") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))
    return w.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in OUTPUTS],
        F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
