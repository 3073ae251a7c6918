"""Merkle manifest of a dataset: a tree of digests over each group's rows and over the groups.

Method: bitmap-rank indexing. A row's place in its group is the number of the group's smaller ids.
The ids of a group are kept as bitmaps of 32,768 ids each, merged from what the tasks have seen and
cut to the bytes between the first and the last bit; a directory holds the number of bits ahead of
every 64 bytes, and running sums over the bitmaps the number of rows ahead of each. A rank is the two
counts plus the bits of at most 63 bytes: no group is ever sorted by id. Ranks give every node its
parent (rank / fanout) and its slot there (rank % fanout), so each level is one grouping by parent into
arrays filled by slot, of at most ``fanout`` digests. Levels shrink by the fanout and are written to the
shared folder. Siblings then come down from the roots, level by level, shared by all rows below a node.

Ids which several rows of a group hold have a second bitmap beside the first, with the running numbers
of their repeats; such rows stand in the order of their digests (running sums cut by that order).

Built-in columns only; no row ever carries a text beyond the scan.

Defined cases: a null field is written as ``-``; a null id stands before all others; rows with the same
id stand in the order of their leaves, equal rows in any order (they have equal leaves); null is a group
of its own and the first; a group of one row has its leaf as subroot; an empty table gives an empty
table; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise.operators.prefix import prefix_sums
from sitewise.sources.scratch import stored

#: Ids of one bitmap, as a power of two; Spark's bitmaps have 4,096 bytes.
BITS = 15
#: Below the bitmap of any id: nulls come first.
NULL_BUCKET = -(1 << 62)
#: Bytes between two entries of a directory, as a power of two.
STEP = 6


def encoded(value: Column) -> Column:
    """Byte length, colon, value; a lone dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of all parts together."""
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda d, step: digest(_hex(step["left"]), d, _hex(step["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as hex, from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(_hex(step["left"]), _hex(step["right"]))), "")


def merkle_manifest(
    docs: DataFrame,
    id: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    keep: Mapping[str, Column] | None = None,
    fanout_bits: int = 4,
) -> DataFrame:
    """One row per input row: the id, ``leaf``, the columns of ``keep``, ``rank`` (place in its group),
    ``subroot``, ``root`` (all digests in hex) and ``path``, an array of (left, right) siblings as bytes.

    ``id`` is a whole number, ``group`` a string. ``keep`` names further expressions over the input,
    worked out in its scan; they should be narrow.
    """
    keep = dict(keep or {})
    leaf = digest(*(encoded(F.col(c)) for c in fields))
    rows = stored(docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("g"),
        F.col(id).cast("bigint").alias("id"),
        F.unhex(leaf).alias("leaf"),
        F.struct(F.lit(0).alias("none"), *(v.alias(n) for n, v in keep.items())).alias("keep"),
        F.monotonically_increasing_id().alias("row"),
    ), "merkle-leaves").withColumns({
        "bucket": F.coalesce(F.shiftright("id", BITS), F.lit(NULL_BUCKET)),
        "pos": F.coalesce(F.col("id").bitwiseAND((1 << BITS) - 1), F.lit(0)).cast("int"),
    })
    index = bitmap_index(rows)
    placed = ranked(rows, index)
    most = index.agg(F.max("total")).first()[0] or 0
    runs = stored(_runs(placed, F.struct("id", "leaf", "keep", "rank"), fanout_bits).withColumns({
        "size": F.col("n"), "n": _ceil(F.col("n"), fanout_bits),
        "digest": F.when(F.col("n") == 1, F.col("kids")[0]["leaf"]).otherwise(_node(F.transform("kids", lambda k: k["leaf"]))),
    }), "merkle-runs")

    # Up: the levels of every group, then those over the groups.
    nodes = runs.select("g", F.col("run").alias("rank"), "n", "digest")
    levels, tops = _reduce(nodes, _up(most, fanout_bits), fanout_bits)
    tops = stored(tops, "merkle-subroots")
    ordered = prefix_sums(tops, [], ["g"], {"nth": F.lit(1)}, {"nth": "n"})
    over = ordered.select(F.lit("").alias("g"), F.col("g").alias("group"), (F.col("nth") - 1).alias("rank"), "n", "digest")
    upper, roots = _reduce(over.drop("group"), tops.count(), fanout_bits)

    # Down: the siblings of each node.
    top = roots.select("g", F.col("digest").alias("root"), F.lit(None).cast(PATH).alias("path"))
    top = top.withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    by_group = _paths(upper, over.drop("group"), top, ["root"], fanout_bits)
    group_paths = over.drop("g").join(by_group, "rank").select(
        F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", "path"
    )
    below = _paths(levels, nodes, stored(group_paths, "merkle-groups"), ["subroot", "root"], fanout_bits)
    ended = runs.join(below.withColumnRenamed("rank", "run"), ["g", "run"])
    each = ended.select("size", "subroot", "root", F.col("path").alias("above"), "kids", F.posexplode("kids").alias("slot", "kid"))
    own = _step(F.transform("kids", lambda k: k["leaf"]), F.col("slot"))
    return each.select(
        F.col("kid.id").alias(id), _hex(F.col("kid.leaf")).alias("leaf"), *(F.col(f"kid.keep.{n}").alias(n) for n in keep),
        F.col("kid.rank").alias("rank"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.when(F.col("size") == 1, F.col("above")).otherwise(F.concat(own, "above")).alias("path"),
    )


def bitmap_index(rows: DataFrame) -> DataFrame:
    """From (g, bucket, pos) one row per bitmap: its bytes from byte ``low`` on, their directory, the
    number of rows in it, ahead of it (``before``) and in its whole group (``total``).

    For ids held by several rows also ``again`` (bytes and directory of a bitmap of these ids) and
    ``extra``, the running numbers of rows beyond the first of each.
    """
    found = stored(_bitmaps(rows, F.count(F.lit(1)).alias("rows")), "merkle-bitmaps")
    index = prefix_sums(found, ["g"], ["bucket"], {"upto": F.col("rows")}, {"upto": "total"})
    index = index.withColumn("before", F.col("upto") - F.col("rows")).drop("upto")
    repeated = found.where(F.col("rows") > F.bitmap_count("bits")).select("g", "bucket")
    if repeated.isEmpty():
        return index.withColumns({"again": F.lit(None).cast(MAP), "extra": F.lit(None).cast("array<bigint>")})
    several = rows.join(repeated, ["g", "bucket"], "left_semi").groupBy("g", "bucket", "pos").agg(
        (F.count(F.lit(1)) - 1).alias("more")
    ).where(F.col("more") > 0)
    # At most 32,768 ids in a bitmap.
    so_far = W.partitionBy("g", "bucket").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    numbers = F.array_sort(F.collect_list(F.struct("pos", "sum")))
    again = _bitmaps(several.withColumn("sum", F.sum("more").over(so_far)), numbers.alias("numbers")).select(
        "g", "bucket", F.struct("low", "bits", "ahead").alias("again"),
        F.transform("numbers", lambda x: x["sum"]).alias("extra"),
    )
    return index.join(again, ["g", "bucket"], "left")


def ranked(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with ``rank``, the place in their group, and ``n``, the size of the group."""
    index = stored(index, "merkle-index")
    found = rows.join(index, ["g", "bucket"])
    at = rank_query(F.struct("low", "bits", "ahead"), F.col("pos"))
    if index.where(F.col("again").isNotNull()).isEmpty():
        return found.select(*rows.columns, F.col("total").alias("n"), (F.col("before") + at).alias("rank"))
    seen = F.coalesce(rank_query(F.col("again"), F.col("pos")), F.lit(0))
    upto = F.coalesce(rank_query(F.col("again"), F.col("pos") + 1), F.lit(0))
    staged = found.select(*rows.columns, F.col("total").alias("n"), (F.col("before") + at).alias("_at"), "extra", seen.alias("_seen"), upto.alias("_upto"))
    first = staged.select(
        *rows.columns, "n", (F.col("_upto") > F.col("_seen")).alias("_tied"),
        (F.col("_at") + F.coalesce(F.get("extra", F.col("_seen").cast("int") - 1), F.lit(0))).alias("rank"),
    )
    ties = prefix_sums(first.where("_tied"), ["g", "bucket", "pos"], ["leaf", "row"], {"_nth": F.lit(1)})
    ties = ties.withColumn("rank", F.col("rank") + F.col("_nth") - 1).drop("_nth")
    return first.where("not _tied").unionByName(ties).drop("_tied")


MAP = "struct<low:int,bits:binary,ahead:array<bigint>>"
PATH = "array<struct<left:binary,right:binary>>"


def rank_query(bitmap: Column, pos: Column) -> Column:
    """Number of bits set below a position: directory, whole bytes, and the bits of one byte."""
    bits, byte = bitmap["bits"], F.shiftright(pos, 3) - bitmap["low"]
    size = F.octet_length(bits)
    at = F.least(F.greatest(byte, F.lit(0)), size)
    block = F.least(F.shiftright(at, STEP), F.size(bitmap["ahead"]) - 1)
    whole = F.bitmap_count(F.substring(bits, F.shiftleft(block, STEP) + 1, at - F.shiftleft(block, STEP)))
    value = F.coalesce(F.conv(F.hex(F.substring(bits, byte + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
    below = F.call_function("shiftleft", F.lit(1), pos.bitwiseAND(7)) - 1
    part = F.when((byte >= 0) & (byte < size), F.bit_count(value.bitwiseAND(below))).otherwise(0)
    return F.get(bitmap["ahead"], block) + whole + part


def _bitmaps(rows: DataFrame, *more: Column) -> DataFrame:
    """One bitmap for each (g, bucket), cut to its bytes in use, with its directory."""
    made = rows.groupBy("g", "bucket").agg(
        F.call_function("bitmap_construct_agg", F.col("pos").cast("bigint")).alias("bits"),
        F.min("pos").alias("first"), F.max("pos").alias("last"), *more,
    )
    low = F.shiftright("first", 3)
    cut = made.withColumns({"low": low, "bits": F.substring("bits", low + 1, F.shiftright("last", 3) - low + 1)})
    blocks = F.sequence(F.lit(0), F.shiftright(F.octet_length("bits") - 1, STEP))
    ahead = F.transform(blocks, lambda b: F.bitmap_count(F.substring(F.col("bits"), F.lit(1), F.shiftleft(b, STEP))))
    return cut.withColumn("ahead", ahead).drop("first", "last")


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _node(digests: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(digests, _hex), ""), 256))


def _ceil(n: Column, bits: int) -> Column:
    return F.shiftright(n + ((1 << bits) - 1), bits)


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _runs(nodes: DataFrame, kid: Column, bits: int) -> DataFrame:
    """Nodes grouped under their parents, each kid at its slot."""
    slot = F.col("rank").bitwiseAND((1 << bits) - 1).cast("int")
    grouped = nodes.groupBy("g", F.shiftright("rank", bits).alias("run")).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, kid))).alias("by_slot"), F.max("n").alias("n")
    )
    kids = F.transform(F.sequence(F.lit(0), F.size("by_slot") - 1), lambda i: F.col("by_slot")[i])
    return grouped.withColumn("kids", kids).drop("by_slot")


def _reduce(nodes: DataFrame, most: int, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (g, rank, n, digest), lowest first, and the top of each group (g, digest).

    ``most`` is the largest n; there are log(most) levels.
    """
    levels, tops = [], [nodes.where("n = 1")]
    while most > 1:
        level = _runs(nodes.where("n > 1"), F.col("digest"), bits).withColumn("n", _ceil(F.col("n"), bits))
        level = stored(level.withColumn("digest", _node(F.col("kids"))), "merkle-level")
        levels.append(level)
        nodes = level.select("g", F.col("run").alias("rank"), "n", "digest")
        tops.append(nodes.where("n = 1"))
        most = _up(most, bits)
    return levels, reduce(DataFrame.unionByName, tops).select("g", "digest")


def _step(digests: Column, slot: Column) -> Column:
    """A path of one level: the digests left and right of a slot, joined."""
    left = F.slice(digests, F.lit(1), slot)
    right = F.slice(digests, slot + 2, F.size(digests))
    return F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right")))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def _paths(levels: list[DataFrame], nodes: DataFrame, tops: DataFrame, carry: list[str], bits: int) -> DataFrame:
    """Paths (g, rank, carry.., path) of the lowest nodes, from the paths of their groups' tops."""
    lowest = [nodes, *(x.select("g", F.col("run").alias("rank"), "n") for x in levels)]
    paths = None
    for k in range(len(levels), -1, -1):
        here = lowest[k].where("n = 1").select("g", "rank").join(tops, "g").select("g", "rank", *carry, "path")
        if paths is not None:
            parents = levels[k].select("g", "run", "kids").join(paths.withColumnRenamed("rank", "run"), ["g", "run"])
            kids = parents.select("g", "run", *carry, "path", "kids", F.posexplode("kids").alias("slot", "_kid"))
            here = here.unionByName(kids.select(
                "g", (F.shiftleft("run", bits) + F.col("slot")).alias("rank"), *carry,
                F.concat(_step(F.col("kids"), F.col("slot")), "path").alias("path"),
            ))
        paths = here
    return paths
