"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by the key's hash, so that a
batch joins it without moving it.  A batch of documents merge-anti-joins the
runs: keys found in a run lose all their lines, the others belong to the batch's
smallest document that holds them and become a run of level 0.  As soon as a
level has ``FANOUT`` runs they are compacted into one run of the next level.
Runs that are given a folder stay there, and a later job opens them again.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case; keys shorter than ``MIN_CHARS`` are never dropped.  A key is held as
two 64-bit hashes.  Null and empty texts are one empty line.  Documents without
an id come after all others; rows of one id are one document and keep a shared
line in each of them.  Batches must come in order of ids, and each only once: a
batch that a run already holds loses all its lines.  Without documents, nothing
is dropped.  Texts of any length are split where they are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.llm.common import LOWER, NO_ID, UPPER, partitions, unused
from logveil.sources.staging import dense, scratch, staged

MIN_CHARS = 10
FANOUT = 4
#: Batches of the registered query, so many that a level is filled and compacted; a production job has one per ingest.
BATCHES = 6
#: A key in more than this share of a batch's rows, of which there are 1000 at most, is broadcast instead of shuffled.
HEAVY_SHARE = 1 / 1000
#: Lines of a batch that a task which writes what is known of them should have at least.
DENSE = 5000

_KEY = ["h1", "h2"]
_LINES = "split(coalesce(`{}`, ''), '\\n', -1)"


def key_expr(line: str) -> str:
    trimmed = rf"regexp_replace({line}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '')"
    return f"translate({trimmed}, '{UPPER}', '{LOWER}')"


def hash_expr(line: str) -> str:
    """Both hashes of a line's key; null for a short one."""
    return (f"transform(array({key_expr(line)}), k -> if(char_length(k) >= {MIN_CHARS}, "
            "named_struct('h1', xxhash64(k), 'h2', xxhash64(-1L, k)), null))[0]")


def _order(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, t, pos, h1, h2)``: every line with a long key; ``t`` tells apart rows of one id."""
    hashes = F.expr(f"transform({_LINES.format(text)}, l -> {hash_expr('l')})")
    return docs.select(_order(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(hashes).alias("pos", "k")) \
        .where("k IS NOT NULL").select("id", "t", "pos", "k.h1", "k.h2")


class LineRuns:
    """The runs, level by level, in ``folder``, whose complete runs are opened again; without one, in the shared folder until ``close``.

    The name of a run tells its level and its number of buckets.  A job that ends
    between a compaction and the removal of what was compacted leaves keys in two
    runs, which changes no result.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, folder: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = partitions(spark)
        self.kept = folder is not None
        self.folder = folder or scratch(spark, "line-runs")
        self.paths: dict[str, str] = {}
        self.levels: list[list[str]] = []
        for path in self._complete() if self.kept else []:
            level, buckets = (int(n) for n in path.rsplit("/", 1)[1].split("-")[1:3])
            self._hold(level, self._opened(path, buckets))

    def _files(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _complete(self) -> list[str]:
        """The runs in the folder whose writing has ended."""
        files, folder = self._files(self.folder)
        found = sorted(str(s.getPath()) for s in files.listStatus(folder)) if files.exists(folder) else []
        return [p for p in found if p.rsplit("/", 1)[1].startswith("run-") and files.exists(self._files(f"{p}/_SUCCESS")[1])]

    def _opened(self, path: str, buckets: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT) USING parquet CLUSTERED BY ({', '.join(_KEY)}) "
                       f"SORTED BY ({', '.join(_KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.paths[name] = path
        return name

    def _write(self, keys: DataFrame, level: int) -> str:
        name = uuid.uuid4().hex
        path = f"{self.folder}/run-{level}-{self.buckets}-{name}"
        (keys.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", path).saveAsTable(f"line_run_{name}"))
        self.paths[f"line_run_{name}"] = path
        return f"line_run_{name}"

    def _hold(self, level: int, run: str) -> None:
        while level >= len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)

    def _compact(self, level: int) -> None:
        runs = self.levels[level]
        merged = self.spark.table(runs[0])
        for run in runs[1:]:
            merged = merged.unionAll(self.spark.table(run))
        self._hold(level + 1, self._write(merged, level + 1))
        for run in runs:
            self._drop(run)
        self.levels[level] = []
        if len(self.levels[level + 1]) >= self.fanout:
            self._compact(level + 1)

    def _drop(self, run: str, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        path = self.paths.pop(run)
        if files:
            where, path = self._files(path)
            where.delete(path, True)

    def close(self) -> None:
        """Take all runs out of the catalogue; files in a folder of their own stay for the next job."""
        for run in self.runs:
            self._drop(run, not self.kept)
        self.levels = []

    @property
    def runs(self) -> list[str]:
        return [run for level in reversed(self.levels) for run in level]

    def add(self, keys: DataFrame, last: bool = False) -> DataFrame:
        """Lines of a batch to drop as ``(id, t, pos)``; the batch's new keys become a run unless it is the last."""
        number = keys.count()
        thick = lambda rows, name: staged(dense(rows, number, DENSE), name)
        held = keys.groupBy(*_KEY).agg(F.min("id").alias("owner"), F.max("id").alias("top"), F.count("*").alias("n"))
        held = thick(held, "line-keys") if self.runs or not last else held
        fresh, seen = held, None
        for run in self.runs:
            known = self.spark.table(run)
            found = fresh.join(known, _KEY, "left_semi")
            seen = found if seen is None else seen.unionAll(found)
            fresh = fresh.join(known, _KEY, "left_anti")
        shared = fresh.where("owner < top").select(*_KEY, "owner", "n")
        if seen is not None:
            shared = shared.unionAll(seen.select(*_KEY, F.lit(None).cast("bigint").alias("owner"), "n"))
        shared = thick(shared, "line-owners")
        doomed = thick(self._doomed(keys, shared), "line-drops")
        if not last:
            self._hold(0, self._write(fresh.select(*_KEY), 0))
            if len(self.levels[0]) >= self.fanout:
                self._compact(0)
        return doomed

    def _doomed(self, keys: DataFrame, shared: DataFrame) -> DataFrame:
        total = shared.agg(F.sum("n").alias("n")).first()["n"] or 0
        hot = F.col("n") > max(1, total * HEAVY_SHARE)
        heavy, light = shared.where(hot).drop("n"), shared.where(~hot).drop("n")
        by_heavy = keys.join(F.broadcast(heavy), _KEY)
        by_light = keys.join(F.broadcast(heavy.select(*_KEY)), _KEY, "left_anti").join(light, _KEY)
        return by_heavy.unionAll(by_light).where("owner IS NULL OR id <> owner").select("id", "t", "pos")


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """``(id, t, pos)`` of the lines to drop, the documents taken in ``batches`` ranges of ids.

    ``folder`` holds the runs of earlier documents, whose lines go too, and gets those of these.
    """
    spark = docs.sparkSession
    cuts = [] if batches < 2 else docs.select(_order(doc_id).alias("id")).where(F.col("id") != NO_ID).approxQuantile(
        "id", [i / batches for i in range(1, batches)], 0.01)
    edges = sorted({int(c) for c in cuts})
    number = sum((F.col("id") > e).cast("int") for e in edges) if edges else F.lit(0)
    keys = staged(line_keys(docs, doc_id, text).withColumn("batch", number), "line-hashes")
    runs, doomed = LineRuns(spark, folder=folder), None
    for batch in range(len(edges) + 1):
        found = runs.add(keys.where(F.col("batch") == batch).drop("batch"), last=batch == len(edges) and not runs.kept)
        doomed = found if doomed is None else doomed.unionAll(found)
    runs.close()
    return doomed


def gathered(doomed: DataFrame) -> DataFrame:
    """``(id, t, gone)``: the distinct lines to drop of each text, however many equal rows it is in."""
    return doomed.groupBy("id", "t").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """``docs`` with the kept lines joined by line feeds in ``text``, and with ``n_lines`` and ``n_dropped``.

    Columns of ``docs`` with these two names are replaced.  A null text stays null if nothing is dropped.
    """
    key, row, gone = unused(docs, "_id"), unused(docs, "_row"), unused(docs, "_gone")
    doomed = gathered(decisions(docs, doc_id, text, batches, folder)).toDF(key, row, gone)
    joined = docs.withColumn(key, _order(doc_id)).withColumn(row, F.xxhash64(text)).join(doomed, [key, row], "left")
    lines = _LINES.format(text)
    kept = (f"if({gone} IS NULL, `{text}`, array_join(transform(array({lines}), l -> "
            f"transform(array_except(sequence(0, size(l) - 1), {gone}), i -> l[i]))[0], '\\n'))")
    out = joined.withColumn("n_lines", F.expr(f"cast(size({lines}) AS bigint)")).withColumn(
        "n_dropped", F.expr(f"cast(coalesce(size(array_distinct({gone})), 0) AS bigint)")).withColumn(text, F.expr(kept))
    return out.drop(key, row, gone)


def digest(kept: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return kept.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


KEPT_SQL = f"""
lines AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {{docs}})),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '') AS text
  FROM lines LEFT JOIN owners USING (k) GROUP BY doc_id)"""

ORACLE = f"WITH {KEPT_SQL.format(docs='documents').strip()} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"
