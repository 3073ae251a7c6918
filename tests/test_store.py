import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitewise.operators.reports import status_counts
from sitewise.plans.site_output import site_results
from sitewise.streaming import incremental
from sitewise.streaming.store import RunStore
from tests.fixtures import LONG, page
from tests.test_fetches import seen, table


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def batch_of(spark, keys, n):
    return spark.createDataFrame([(k, n, i) for k in keys for i in range(2)], "row_id string, v int, i int")


def test_newest_run_wins_and_runs_stay_few(spark, tmp_path):
    store, now = RunStore(spark, str(tmp_path / "s"), slices=2, fan_in=3), {}
    assert store.read() is None
    rng = random.Random(1)
    for n in range(11):
        keys = rng.sample("abcdefgh", 3)
        now |= {k: n for k in keys}
        assert store.commit(n, batch_of(spark, keys, n)).count() == 6
        # Fewer runs than fan_in on each of log(batches) levels.
        assert len(store.manifest()["runs"]) <= 2 * 3
    assert rows(store.read(), "row_id", "v", "i") == sorted((k, n, i) for k, n in now.items() for i in range(2))
    wanted = spark.createDataFrame([("a",), ("h",), ("zz",)], "row_id string")
    assert {(r.row_id, r.v) for r in store.read(keys=wanted).collect()} == {(k, now[k]) for k in "ah" if k in now}
    kept = {tuple(r) for r in store.manifest()["runs"]}
    folders = {(int(p.parent.name[6:]), int(p.name[9:])) for p in (tmp_path / "s").glob("level=*/batch_id=*")}
    assert kept <= folders and len(folders) <= len(kept) + 5
    assert len(store.batches()) == 2


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"), slices=1, fan_in=3)
    wanted = spark.createDataFrame([("a",)], "row_id string")
    held = []
    for n in range(20):
        store.commit(n, batch_of(spark, ["a", "b"], n))
        held.append(sum(spark.read.parquet(store.folder(r)).count() for r in store.manifest()["runs"]))
        if n in (4, 19):
            assert rows(store.read(n + 1, wanted), "row_id", "v") == [("a", n)] * 2
    assert max(held[10:]) <= max(held[:10]) + 4 and max(held) <= 4 * 6


def test_a_batch_done_again_replaces_what_it_left(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"), slices=2, fan_in=2)
    for n in range(4):
        store.commit(n, batch_of(spark, "ab", n))
        before = rows(store.read(n), "row_id", "v") if n else []
        store.commit(n, batch_of(spark, "a", 10 + n))
        assert (rows(store.read(n), "row_id", "v") if n else []) == before
        store.commit(n, batch_of(spark, "ab", n))
        assert rows(store.read(), "row_id", "v") == [("a", n)] * 2 + [("b", n)] * 2


def test_refetches_in_batches_equal_one_job(spark, tmp_path):
    rng = random.Random(4)
    data = []
    for i in range(160):
        u = rng.randrange(14)
        kind = rng.random()
        html = "" if kind < 0.3 else page(f"{i} {LONG}")
        method = "playwright" if rng.random() < 0.3 else "requests"
        data.append(seen(f"u{u}", i, html, None if method == "playwright" else rng.choice([200, 503]), method, "e" if kind < 0.2 else "", u, f"s{i % 4}"))
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    done = []
    for n in range(6):
        part = data[n::6]
        done += part
        table(spark, *part).coalesce(1).write.mode("append").parquet(source)
        incremental.run_incremental_sites(spark, source, table(spark, *part).schema, work, slices=2, max_files_per_trigger=1)
    got, want = incremental.current_results(spark, work), site_results(table(spark, *done), merge=True)
    assert rows(got) == rows(want.select(*got.columns))
    state, _ = incremental.site_stores(spark, work, 2)
    assert state.read().groupBy("row_id").count().agg(F.max("count")).first()[0] <= 12


def test_a_killed_batch_replays_to_the_same_rows(spark, tmp_path, monkeypatch):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    first = table(spark, *(seen(f"u{i}", i, page(LONG), pos=i) for i in range(4)))
    again = table(spark, seen("u1", 50, "", 503, pos=1), seen("u9", 60, page(LONG), pos=9))
    first.coalesce(1).write.parquet(source)
    incremental.run_incremental_sites(spark, source, first.schema, work, slices=2)
    again.coalesce(1).write.mode("append").parquet(source)
    rolled = incremental._rolled
    with monkeypatch.context() as m:
        m.setattr(incremental, "_rolled", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception):
            incremental.run_incremental_sites(spark, source, first.schema, work, slices=2)
    assert incremental._rolled is rolled
    incremental.run_incremental_sites(spark, source, first.schema, work, slices=2)
    got = incremental.current_results(spark, work)
    assert rows(got) == rows(site_results(first.unionByName(again), merge=True).select(*got.columns))


def test_a_site_done_again_moves_its_count(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "row_id string, input_file string, scrape_status string, at int"
    batches = [
        [("a", "f", "error", 1), ("b", "f", "done", 1), ("b", "f", "error", 0), ("c", None, None, 1)],
        [("a", "f", "done", 2), ("b", "f", "error", 0), ("c", "g", "done", 1)],
        [("a", "f", "error", 1), ("d", "f", "skipped", 5)],
        [(k, "f", "done", 9) for k in "abcd"],
    ]
    so_far = []
    for batch in batches:
        so_far += batch
        part = spark.createDataFrame(batch, schema)
        part.coalesce(1).write.mode("append").parquet(source)
        incremental.run_live_status(spark, source, part.schema, work, order=["at"], slices=2)
        latest = {}
        for r in so_far:
            if r[0] not in latest or r[3] >= latest[r[0]][3]:
                latest[r[0]] = r
        want = status_counts(spark.createDataFrame(list(latest.values()), schema))
        got = incremental.live_status(spark, work)
        assert rows(got) == rows(want.select(*got.columns))
    assert got.count() == 1 and got.first().rows_done == 4


def test_a_file_with_one_row_group_is_dealt_out(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    data = table(spark, *(seen(f"u{i}", i, page(f"{i} {LONG}"), 200, "requests", "", i, f"s{i % 9}") for i in range(60)))
    data.coalesce(1).write.parquet(source)
    incremental.run_incremental_sites(spark, source, data.schema, work, slices=2, max_files_per_trigger=1)
    incoming = spark.read.parquet(f"{work}/incoming").groupBy(F.input_file_name()).count()
    assert incoming.count() > 1 and incoming.agg(F.sum("count")).first()[0] == 60
    got, want = incremental.current_results(spark, work), site_results(data, merge=True)
    assert rows(got) == rows(want.select(*got.columns))
