"""Keyed state on files: rows of a key are replaced as a whole by the newest run which has the key.

Each batch writes a run. When a level has ``fan_in`` runs they are merged into one of the next level, so
there are at most ``fan_in`` - 1 runs on each of log(batches) levels, and what is read for a key does not
grow with the batches which never touched it. A manifest for each batch names the runs which count; it is
there as a whole or not at all. A batch reads the manifest before its own, so a batch which died and is
done again starts from the same rows and replaces what it left. Runs which neither of the last two
manifests names are removed.

Runs are partitioned by a slice of the key: a batch opens only the slices of its keys, and in these a
Bloom filter drops other keys in the scan stage.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.operators.bloom import may_match
from sitewise.sources.snapshots import names_in, read_text, remove, write_text

#: Writing tasks for each slice.
SPREAD = 4


class RunStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "row_id", slices: int = 64, fan_in: int = 4):
        self.spark, self.path, self.key, self.slices, self.fan_in = spark, path, key, slices, fan_in

    def batches(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in names_in(self.spark, f"{self.path}/_manifests") if n.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict:
        """Schema and runs (level, batch), newest first, of the newest manifest (before a batch)."""
        known = [b for b in self.batches() if before is None or b < before]
        if not known:
            return {"schema": None, "runs": []}
        return json.loads(read_text(self.spark, f"{self.path}/_manifests/{known[-1]:010d}.json"))

    def folder(self, run) -> str:
        level, batch = run
        return f"{self.path}/level={level}/batch_id={batch}"

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The rows of all keys, or of those in ``keys`` (a stored table of the key); None before the first batch."""
        found = self.manifest(before)
        if not found["runs"]:
            return None
        slices = None
        if keys is not None:
            slices = [r[0] for r in keys.select(self._slice()).distinct().collect()]
        return self._newest(found["runs"], T.StructType.fromJson(found["schema"]), keys, slices)

    def _slice(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.slices)).cast("int").alias("slice")

    def _newest(self, runs, schema: T.StructType, keys: DataFrame | None = None, slices: list | None = None) -> DataFrame:
        stored = T.StructType([*schema, T.StructField("slice", T.IntegerType())])
        parts = []
        for age, run in enumerate(runs):
            part = self.spark.read.schema(stored).parquet(self.folder(run))
            if slices is not None:
                part = part.where(F.col("slice").isin(slices) if slices else F.lit(False))
            parts.append(part.drop("slice").withColumn("_age", F.lit(age)))
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            # Inner, as the keys are distinct: Spark would move a semi-join below the filter.
            rows = may_match(rows, keys, [self.key]).join(keys.select(self.key).distinct(), self.key)
        if len(runs) > 1:
            # The newest run of each key on two narrow columns; the wide rows are joined to it once.
            newest = rows.groupBy(self.key).agg(F.min("_age").alias("_age"))
            rows = rows.join(newest, [self.key, "_age"])
        return rows.select(*schema.fieldNames())

    def _write(self, rows: DataFrame, run) -> None:
        spread = F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(SPREAD))
        rows.select("*", self._slice()).repartition("slice", spread).write.mode("overwrite").partitionBy("slice").parquet(self.folder(run))

    def commit(self, batch: int, rows: DataFrame) -> DataFrame:
        """Write the rows of a batch, merge runs where a level is full, and name what counts; the rows as stored."""
        schema = rows.schema
        self._write(rows, (0, batch))
        written = self._newest([(0, batch)], schema)
        runs = [(0, batch), *(tuple(r) for r in self.manifest(batch)["runs"])]
        level = 0
        while sum(r[0] == level for r in runs) >= self.fan_in:
            full = [r for r in runs if r[0] == level]
            merged = (level + 1, batch)
            self._write(self._newest(full, schema), merged)
            runs = [r for r in runs if r[0] < level] + [merged] + [r for r in runs if r[0] > level]
            level += 1
        name = f"{self.path}/_manifests/{batch:010d}.json"
        write_text(self.spark, name, json.dumps({"schema": schema.jsonValue(), "runs": runs}))
        self._tidy(batch)
        return written

    def _tidy(self, batch: int) -> None:
        known = [b for b in self.batches() if b <= batch]
        kept = {tuple(r) for b in known[-2:] for r in json.loads(read_text(self.spark, f"{self.path}/_manifests/{b:010d}.json"))["runs"]}
        # The run which was just written is read until the batch ends.
        kept.add((0, batch))
        for folder in names_in(self.spark, self.path):
            if folder.startswith("level="):
                for name in names_in(self.spark, f"{self.path}/{folder}"):
                    run = (int(folder.split("=")[1]), int(name.split("=")[1]))
                    if run not in kept and run[1] <= batch:
                        remove(self.spark, self.folder(run))
        for old in known[:-2]:
            remove(self.spark, f"{self.path}/_manifests/{old:010d}.json")
