import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitewise.llm.catalog import QUERIES
from sitewise.llm.merkle import bitmap_index, folded, merkle_manifest, rank_query, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes, at):
    """Top of a list of nodes, and the siblings of one of them at each level."""
    path = []
    while len(nodes) > 1:
        run = at // 16 * 16
        path.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 16])))
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], path


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        leaves[name] = [leaf_of(*r) for r in groups[name]]
    tops = [climb(leaves[name], 0)[0] for name in names]
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            subroot, path = climb(leaves[name], i)
            root, above = climb(tops, k)
            path += above
            changed, tampered = leaves[name][i], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            if tampered and r[1] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                changed = leaf_of(r[0], lower, *r[2:])
            for left, right in path:
                changed = sha(left, changed, right)
            out.append((r[0], leaves[name][i], subroot, root, sha(*(x for p in path for x in p)), changed, changed == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def table(n, sources, seed=1, ids=None):
    rng = random.Random(seed)
    ids = ids or [i * 37 for i in range(n)]
    rng.shuffle(ids)
    return [(ids[i], rng.choice(["Some Text", "plain", "ÄÖ É X", ""]) + str(rng.randint(0, 3)), rng.choice(["en", None]), rng.choice(sources), i) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "many ids", "ties", "groups", "one", "two"])
def test_equals_brute_force(spark, tmp_path, case):
    if case == "plain":
        rows = table(700, ["a"] * 30 + ["b", None, "é", "B"])
    elif case == "many ids":
        rows = table(300, ["a", "b"], ids=[random.Random(5).randint(-2**63, 2**63 - 1) for _ in range(298)] + [-2**63, 2**63 - 1])
    elif case == "ties":
        rows = table(400, ["a", "a", "a", "b"], ids=[None] * 120 + [7] * 80 + [8] * 40 + list(range(160)))
        rows += rows[:30] + [(9, None, None, None, None)] * 20
    elif case == "groups":
        rows = table(330, [f"s{i}" for i in range(300)])
    elif case == "one":
        rows = [(5, "Only", "en", "a", 4)]
    else:
        rows = [(5, "Only", "en", "a", 4), (6, None, None, None, None)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_and_other_columns(spark):
    docs = spark.createDataFrame([], SCHEMA + ", leaf string, rank int, g int")
    assert merkle_manifest(docs).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "a", 1, "mine", 2)], SCHEMA + ", leaf string, path int")
    got = merkle_manifest(one).first()
    assert got.leaf == got.subroot == got.root == leaf_of(1, "x", "en", "a", 1) and got.path == []


def test_a_path_proves_its_leaf_and_no_other(spark):
    docs = spark.createDataFrame(table(100, ["a", "b"]), SCHEMA)
    got = merkle_manifest(docs).select(
        "*", folded(F.col("leaf"), F.col("path")).alias("up"), folded(F.lit("0" * 64), F.col("path")).alias("other"),
        F.length(siblings(F.col("path"))).alias("chars"),
    ).collect()
    assert len(got) == 100 and all(r.up == r.root and r.other != r.root and r.chars % 64 == 0 for r in got)


def test_ranks_come_from_bitmaps(spark):
    ids = sorted(random.Random(2).sample(range(32768), 900))
    rows = spark.createDataFrame([("g", 0, i) for i in ids], "g string, bucket long, pos int")
    index = bitmap_index(rows).first()
    assert index.low == ids[0] >> 3 and len(index.bits) == (ids[-1] >> 3) - (ids[0] >> 3) + 1
    asked = spark.range(32769).crossJoin(bitmap_index(rows)).select(
        "id", rank_query(F.struct("low", "bits", "ahead"), F.col("id").cast("int")).alias("r")
    ).collect()
    want, n = {}, 0
    members = set(ids)
    for i in range(32769):
        want[i] = n
        n += i in members
    assert {r.id: r.r for r in asked} == want


def test_no_sort_by_id(spark):
    docs = spark.createDataFrame(table(50, ["a", "b"]), SCHEMA)
    plan = merkle_manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
