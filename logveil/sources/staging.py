"""Tables that cut lineage between the barriers of a multi-pass job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session gets a folder of its own; a cluster
    must name one, since executors cannot see each other's local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="logveil-"))
    return spark.conf.get("spark.checkpoint.dir")


_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{staging_dir(spark)}/logveil-{uuid.uuid4().hex}-{name}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and read it back.

    A table, unlike a checkpoint of rows, is compressed and columnar: a pass
    that needs only the keys of a barrier does not read the text beside them.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense(df: DataFrame, rows: int, each: int, moved: bool = False) -> DataFrame:
    """``df`` in fewer partitions, where shuffles have more than twice those that ``rows`` rows need with ``each`` in one.

    Each partition that is staged is a file, and what a file system does for a
    file, such as the processes that a local one starts for its permissions, is
    the same for a few rows.  Two partitions for each core are left.  ``moved``
    rows are shuffled, so that what makes them is spread as before.
    """
    spark = df.sparkSession
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))
    if 2 * wanted >= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(wanted) if moved else df.coalesce(wanted)


def release(spark: SparkSession) -> None:
    """Delete what was staged so far; call it when their results have been written."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
