"""A Bloom filter of keys, tested in the scan stage of a large table.

It drops rows of the large table ahead of costly columns and exchanges; the exact join comes after, on
what is left. The filter has blocks of 4,096 bits, each a row of a table which is broadcast: a key's block
and five places in it come from its hash. Built by a grouped ``bit_or``; built-in columns throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, PLACES = 4096, 5
#: Bits for each key; about one key in a hundred passes by chance.
BITS_PER_KEY = 12
#: A filter larger than this is not built, and the exact join does all the work.
MAX_BYTES = 64 << 20


def _block(on: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(97), *on), F.lit(blocks)).cast("int")


def _places(on: list[Column]) -> list[Column]:
    h = F.xxhash64(F.lit(53), *on)
    return [F.shiftright(h, 12 * i).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(PLACES)]


def bloom_filter(keys: DataFrame, on: list[str], blocks: int) -> DataFrame:
    """(block, words) of the keys, a block as 64 longs."""
    columns = [F.col(c) for c in on]
    bits = keys.select(_block(columns, blocks).alias("block"), F.explode(F.array(*_places(columns))).alias("at"))
    words = bits.groupBy("block", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits")
    )
    listed = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("by_word", w), F.lit(0)))
    return listed.select("block", every.alias("words"))


def may_match(df: DataFrame, keys: DataFrame, on: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``df`` whose columns ``on`` may be among those of ``keys``: all which are, and a few more.

    Nulls count as equal. ``keys`` is counted first, so it should be a stored table. No keys leave no
    rows; with so many that the filter would be over ``max_bytes``, ``df`` comes back as it is. The exact
    join to follow should be an inner one: the optimizer moves semi- and anti-joins below the filter.
    """
    blocks = max(1, math.ceil(keys.count() * BITS_PER_KEY / BLOCK_BITS))
    if blocks * (BLOCK_BITS // 8 + 16) > max_bytes:
        return df
    made = F.broadcast(bloom_filter(keys, on, blocks).withColumnsRenamed({"block": "_block", "words": "_words"}))
    columns = [F.col(c) for c in on]
    hit = F.lit(True)
    for at in _places(columns):
        word = F.get("_words", F.shiftright(at, 6))
        hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63))) != 0)
    return df.join(made, _block(columns, blocks) == F.col("_block")).where(hit).drop("_block", "_words")
