import pytest
from pyspark.sql import functions as F

from sitewise.operators.resume import conform
from sitewise.plans.site_output import site_results
from sitewise.schema import SITE_OUTPUT
from sitewise.sources import scratch, sinks, tables
from tests.fixtures import LONG, fetch, fetch_table, page


def test_site_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('name,website\n"A, ""x""\nB",a.com\nC,\nD,b.com\n')
    got = tables.read_site_list(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r["name"], r.website) for r in got] == [
        (0, 'A, "x"\nB', "a.com"), (1, "C", None), (2, "D", "b.com"),
    ]
    assert got[1].row_id == "row_1"
    (tmp_path / "bad.csv").write_text("name\nx\n")
    with pytest.raises(ValueError, match="website"):
        tables.read_site_list(spark, str(tmp_path / "bad.csv"))


def test_ordinals_of_a_split_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("website\n" + "".join(f"s{i}.com\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        listed = tables.read_site_list(spark, str(tmp_path / "big.csv"), multi_line=False)
        assert listed.count() == 5000
        assert listed.where(F.col("website") != F.concat(F.lit("s"), "ord", F.lit(".com"))).count() == 0
        sheet, _ = tables.read_site_files(spark, str(tmp_path), multi_line=False)
        assert sheet.where(F.col("website") != F.concat(F.lit("s"), "ord", F.lit(".com"))).count() == 0
        assert sheet.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_site_files(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "a.csv").write_text("website,note\na.com,n\n,m\n")
    (tmp_path / "x" / "b.CSV").write_text("﻿note,website,row_id,note\nq,b.com,r7,z\n")
    (tmp_path / "x" / "y" / "c.csv").write_text("site\nc.com\n")
    (tmp_path / "x" / "wide.csv").write_text(",".join(f"c{i}" for i in range(300)) + ",website\n")
    (tmp_path / "d.txt").write_text("website\nd.com\n")
    sheet, failures = tables.read_site_files(spark, str(tmp_path))
    got = sorted((r.input_file, r.ord, r.website, r.attributes.get("note"), r.row_id[:4]) for r in sheet.collect())
    assert got == [
        ("a.csv", 0, "a.com", "n", "site"), ("a.csv", 1, None, "m", "row_"), ("x/b.CSV", 0, "b.com", "q", "r7"),
    ]
    assert sorted(tuple(r) for r in failures.collect()) == [
        ("x/y/c.csv", "the site list needs a 'website' column"),
    ]


def split_small(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def whole_splits(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_file_of_many_splits_with_line_ends_in_values(spark, tmp_path):
    import csv
    import random

    rng = random.Random(2)
    parts = ["a", 'say "x"', "two\nlines", "\n\n", ",", "é", "", None, '"', "x\r\ny", " b ", "c,\"d\",\n"]
    rows = [[f"s{i}.com", rng.choice(parts), "".join(rng.choice(parts) or "" for _ in range(rng.randint(0, 6)))] for i in range(1500)]
    path = tmp_path / "big.csv"
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(["website", "note\n2", "more"])
        for i, r in enumerate(rows):
            writer.writerow(r)
            if i % 50 == 0:
                f.write("\n")
    one = spark.read.options(**tables.CSV_OPTIONS).csv(str(path)).collect()
    assert len(one) == len(rows)
    try:
        for size in (300, 5000):
            split_small(spark, size)
            listed = tables.read_site_list(spark, str(path))
            got = sorted(listed.collect(), key=lambda r: r.ord)
            assert [r.ord for r in got] == list(range(len(rows)))
            assert [tuple(r)[:3] for r in got] == [tuple(r) for r in one]
        assert spark.read.text(str(path)).select(F.spark_partition_id()).distinct().count() > 4
    finally:
        whole_splits(spark)


def test_wide_and_broken_files(spark, tmp_path):
    import gzip

    names = [f"c{i}" for i in range(300)]
    (tmp_path / "wide.csv").write_text(",".join(names) + ",website\n" + ",".join(f"v{i}" for i in range(300)) + ',w.com\n"q""1",,x\n')
    (tmp_path / "crlf.csv").write_bytes(b'website,n\r\na.com,"1\r\n2"\r\n\r\nb.com,\r\n')
    (tmp_path / "sp ace").mkdir()
    (tmp_path / "sp ace" / "ok.csv").write_text('website,n\nc.com,""\n')
    sheet, failures = tables.read_site_files(spark, str(tmp_path))
    got = {(r.input_file.replace("%20", " "), r.ord): (r.website, r.attributes) for r in sheet.collect()}
    assert got["wide.csv", 0] == ("w.com", {f"c{i}": f"v{i}" for i in range(300)}) and got["wide.csv", 1] == (None, {"c0": 'q"1', "c2": "x"})
    assert got["crlf.csv", 0] == ("a.com", {"n": "1\r\n2"}) and got["crlf.csv", 1] == ("b.com", {})
    assert got["sp ace/ok.csv", 0] == ("c.com", {"n": ""}) and len(got) == 5
    assert failures.count() == 0
    whole = gzip.compress(("website\n" + "\n".join(f"{i}.com" for i in range(20000))).encode())
    (tmp_path / "good.csv.gz").write_bytes(whole)
    (tmp_path / "broken.csv.gz").write_bytes(b"\x1f\x8b\x08" + b"no gzip at all" * 9)
    sheet, failures = tables.read_site_files(spark, str(tmp_path), ".csv.gz")
    assert sheet.count() == 20000 and {r.input_file for r in sheet.select("input_file").distinct().collect()} == {"good.csv.gz"}
    assert [tuple(r) for r in failures.collect()] == [("broken.csv.gz", "the file could not be read")]


def test_earlier_output(spark, tmp_path):
    assert tables.read_earlier_output(spark, str(tmp_path / "none")).schema == SITE_OUTPUT
    results = site_results(fetch_table(spark, [
        fetch("a", "u", 0, page('He said "hi"<br>\n, twice' + LONG)), fetch("b", "v", 0, ""),
    ]))
    sinks.write_sites(results, str(tmp_path / "table"))
    stored = tables.read_earlier_output(spark, str(tmp_path / "table"))
    assert stored.exceptAll(results).count() == 0 and stored.count() == 2
    sinks.export_csv(stored, str(tmp_path / "copy.csv"))
    copy = tables.read_earlier_output(spark, str(tmp_path / "copy.csv"))
    assert copy.dtypes == stored.dtypes
    assert copy.fillna("").exceptAll(stored.fillna("")).count() == 0 and copy.count() == 2
    sinks.write_checkpoint(stored, str(tmp_path / "done"))
    assert [r.row_id for r in spark.read.parquet(str(tmp_path / "done")).collect()] == ["a"]


def test_conform(spark):
    table = conform(spark.createDataFrame([("r", "x")], "row_id string, extra string"))
    assert table.columns == ["row_id", "extra"] + [c for c in SITE_OUTPUT.names if c != "row_id"]
    row = table.first()
    assert row.scrape_status == "" and row.final_url == "" and row.site_title is None


class Session:
    """A session as far as its settings go."""

    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_scratch_folder(spark, tmp_path):
    shared = Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")
    assert scratch.scratch_dir(shared, "p").startswith("hdfs://x/y/sitewise/p-")
    assert scratch.scratch_dir(shared, "p") != scratch.scratch_dir(shared, "p")
    warehouse = Session(spark_master="yarn", spark_sql_warehouse_dir="hdfs://w")
    assert scratch.scratch_dir(warehouse, "p").startswith("hdfs://w/sitewise/p-")
    assert scratch.scratch_dir(spark, "p")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_dir(Session(spark_master="yarn", spark_sql_warehouse_dir="file:/tmp/w"), "p")
