"""Line dedup: lines found in many documents leave every document.

Method: explode normalised lines, hash them, count the documents of each hash, and drop
the lines over the threshold; what is left is put together by position. Built-in columns only.

Shuffles: one counted row per distinct line and task; the positions of frequent lines; the
documents once, for the join with those positions. A line which is in a third of all rows is
counted in part before the shuffle, and the positions are grouped by document, so no line's
rows meet in one task. The frequent lines are stored first, so that Spark knows their size and
broadcasts them only where they are below its threshold.

Defined cases: null text counts as one empty line and comes back as an empty text; rows with
null id or repeated rows are documents of their own; an empty table gives an empty table; extra
columns are kept, and columns named like an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import WHITE, ascii_lower, row_key
from sitewise.sources.scratch import stored


def _keys(text: Column) -> Column:
    lines = F.split(ascii_lower(text), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(WHITE)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(3), key).alias("h1"), F.xxhash64(F.lit(5), key).alias("h2")]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(h1, h2): hashes of line keys of ``min_chars`` or more found in ``min_docs`` documents."""
    keys = docs.select(F.coalesce(text, F.lit("")).alias("t")).select(
        F.explode(F.array_distinct(F.filter(_keys(F.col("t")), lambda k: F.length(k) >= min_chars))).alias("key")
    )
    counts = keys.select(*_hashed(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("docs"))
    return counts.where(F.col("docs") >= min_docs).select("h1", "h2")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, n_lines (before) and n_dropped."""
    if min_chars < 1 or min_docs < 1:
        raise ValueError("min_docs and min_chars start at 1")
    bad = stored(frequent_lines(docs, min_docs, min_chars, text), "frequent-lines")
    whole = F.coalesce(text, F.lit(""))
    lines = docs.select(*row_key(F.col(doc_id), F.col(text)), whole.alias("t"))
    hits = (
        lines.select("k1", "k2", F.posexplode(_keys(F.col("t"))).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select("k1", "k2", "pos", *_hashed(F.col("key")))
        .join(bad, ["h1", "h2"], "left_semi")
        # Repeated rows share a key: their positions are the same.
        .groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    )
    rows = docs.select(F.struct("*").alias("row"), *row_key(F.col(doc_id), F.col(text)))
    split = F.split(F.coalesce(F.col(f"row.{text}"), F.lit("")), "\n", -1)
    joined = rows.join(hits, ["k1", "k2"], "left").select("row", "gone", split.alias("lines"))
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in (text, "n_lines", "n_dropped")],
        F.when(F.col("gone").isNull(), F.coalesce(F.col(f"row.{text}"), F.lit(""))).otherwise(kept).alias(text),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
