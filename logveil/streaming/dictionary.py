"""A dictionary of pseudonyms that grows from batch to batch, as a log-structured table.

Each batch adds a run with its new entries.  ``FANOUT`` runs of a level are merged
into one of the next, so there are few runs however many batches there were.  A
run is partitioned by a prefix of its values' digests, long enough that a
partition has about ``PART`` entries, so a batch reads of each run only the
partitions that its own values fall into.  The numbers go on from a small table
of the greatest ones, without looking at the entries.

Batch *n* reads the state that batch *n-1* left and overwrites its own run and
state.  Runs that were merged are deleted two batches later, when no batch that
reads them can be run again.  So a batch that is run again gives the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.sources.staging import staged

FANOUT, PART = 8, 50_000
ENTRIES = "_scope string, category string, body string, original string, id bigint, n bigint, replacement string, number string"
ENTRIES_COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]
_STATE = "level int, name string, digits int, size bigint"
_LAST = "_scope string, category string, last bigint"


@dataclass
class DictionaryLog:
    path: str
    fanout: int = FANOUT
    part: int = PART

    def before(self, spark: SparkSession, batch_id: int) -> KnownEntries:
        """The entries of all batches before ``batch_id``."""
        if batch_id == 0:
            return KnownEntries(spark, self.path, [], spark.createDataFrame([], _LAST))
        state = spark.read.schema(_STATE).parquet(f"{self.path}/state/batch={batch_id - 1}")
        runs = [tuple(r) for r in state.orderBy("level", "name").collect()]
        return KnownEntries(spark, self.path, runs, spark.read.schema(_LAST).parquet(f"{self.path}/last/batch={batch_id - 1}"))

    def add(self, entries: DataFrame, batch_id: int) -> None:
        """Keep the new entries of a batch, and merge runs where a level is full."""
        spark = entries.sparkSession
        known, entries = self.before(spark, batch_id), staged(entries.select(*ENTRIES_COLUMNS), "new-entries")
        runs, level, merged = known.runs, 0, entries
        while len(full := [r for r in runs if r[0] == level]) + 1 >= self.fanout:
            merged = merged.unionByName(known.of(full))
            runs, level = [r for r in runs if r[0] != level], level + 1
        runs = [*runs, self._write(merged, level, batch_id)]
        last = known.last.unionByName(entries.select("_scope", "category", F.col("id").alias("last"))) \
            .groupBy("_scope", "category").agg(F.max("last").alias("last"))
        last.write.mode("overwrite").parquet(f"{self.path}/last/batch={batch_id}")
        spark.createDataFrame(runs, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
        if batch_id > 1:
            self._forget(spark, {r[1] for r in self.before(spark, batch_id - 1).runs} - {r[1] for r in known.runs})

    def _write(self, entries: DataFrame, level: int, batch_id: int) -> tuple[int, str, int, int]:
        size = entries.count()
        digits = max(0, math.ceil(math.log(max(1, size / self.part), 16)))
        name = f"level-{level}-batch-{batch_id}"
        prefix = F.concat(F.lit("p"), F.substring(F.md5("body"), 1, digits))
        entries.withColumn("_prefix", prefix).repartition("_prefix").write.mode("overwrite").partitionBy("_prefix").parquet(f"{self.path}/runs/{name}")
        return level, name, digits, size

    def _forget(self, spark: SparkSession, names: set[str]) -> None:
        for name in names:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class KnownEntries:
    """What a batch may read: ``runs`` of ``(level, name, digits, size)``, and the greatest numbers so far as ``last``."""

    spark: SparkSession
    path: str
    runs: list[tuple[int, str, int, int]]
    last: DataFrame
    #: partitions that ``among`` was to read, by run
    read: list[tuple[str, int]] = field(default_factory=list)

    def _run(self, run: tuple[int, str, int, int]) -> DataFrame:
        return self.spark.read.schema(f"{ENTRIES}, _prefix string").parquet(f"{self.path}/runs/{run[1]}")

    def of(self, runs: list[tuple[int, str, int, int]]) -> DataFrame:
        found = self.spark.createDataFrame([], ENTRIES)
        for run in runs:
            if run[3]:
                found = found.unionByName(self._run(run).drop("_prefix"))
        return found

    def all(self) -> DataFrame:
        return self.of(self.runs)

    def among(self, keys: DataFrame) -> DataFrame:
        """The entries of ``keys(_scope, body)``, from the partitions that these fall into."""
        keys = keys.select("_scope", "body").distinct()
        digits = max((r[2] for r in self.runs), default=0)
        # as many as the longest run has partitions, so a small part of its entries
        prefixes = [r["p"] for r in keys.select(F.substring(F.md5("body"), 1, digits).alias("p")).distinct().collect()] if self.runs else []
        found = self.spark.createDataFrame([], ENTRIES)
        for run in self.runs:
            wanted = sorted({"p" + p[:run[2]] for p in prefixes})
            self.read.append((run[1], len(wanted)))
            if wanted and run[3]:
                found = found.unionByName(self._run(run).filter(F.col("_prefix").isin(wanted)).drop("_prefix"))
        return found.join(keys, ["_scope", "body"], "left_semi").select(*ENTRIES_COLUMNS)
