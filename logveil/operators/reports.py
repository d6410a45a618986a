"""Counts, manifests and run reports: ordinary aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions import files as P

MIB = 1024 * 1024


def counts_by_document(rows: DataFrame, *id_cols: str) -> DataFrame:
    """``(*id_cols, category, n)``, counted inside each row, without a shuffle."""
    names = "transform(hits, h -> h.category)"
    return rows.select(*id_cols, F.explode(F.expr(
        f"transform(array_distinct({names}), c -> named_struct('category', c, "
        f"'n', cast(size(filter(hits, h -> h.category = c)) AS bigint)))")).alias("x")).select(*id_cols, "x.*")


def totals(counts: DataFrame) -> DataFrame:
    """``(category, n)`` over all documents, in category order."""
    return counts.groupBy("category").agg(F.sum("n").cast("bigint").alias("n")).orderBy("category")


def replacements_by_document(counts: DataFrame, *id_cols: str) -> DataFrame:
    return counts.groupBy(*id_cols).agg(F.sum("n").cast("bigint").alias("n"))


def distinct_originals(findings: DataFrame, approximate: bool = False) -> DataFrame:
    """``(category, n)``: how many different values each category has."""
    distinct = F.approx_count_distinct("original") if approximate else F.count_distinct("original")
    return findings.groupBy("category").agg(distinct.cast("bigint").alias("n"))


#: Logarithm of a sketch's registers: a standard error of 0.8 %, in at most 16 KB.
SKETCH_BITS = 14


def original_sketches(findings: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, category, sketch)``: what a run keeps, in place of the values, to count the different ones of many runs."""
    return findings.groupBy(*keys, "category").agg(F.hll_sketch_agg("original", F.lit(SKETCH_BITS)).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str, run: str) -> None:
    """Keep a run's sketches; a run that is done again replaces its own."""
    sketches.write.mode("overwrite").parquet(f"{path}/run={run}")


def sketched_originals(sketches: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, category, n)``: about how many different values there are in all the sketches together."""
    return sketches.groupBy(*keys, "category").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def manifest_rollup(manifest: DataFrame) -> DataFrame:
    """Files and bytes per class and size class, with every subtotal and the grand total."""
    return manifest.rollup("class", "size_class").agg(
        F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes")).select(
        F.coalesce("class", F.lit("all")).alias("class"),
        F.coalesce("size_class", F.lit("all")).alias("size_class"), "files", "bytes")


def throughput(metrics: DataFrame, phase: str | None = None) -> DataFrame:
    """Overall and mean throughput of ``metrics(file, bytes, seconds)``, in MiB per second."""
    keys = [phase] if phase else []
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("seconds").alias("seconds"),
        (F.sum("bytes") / F.lit(MIB) / F.sum("seconds")).alias("overall_mib_s"),
        F.avg(F.col("bytes") / F.lit(MIB) / F.col("seconds")).alias("mean_mib_s"))


def time_left(done: DataFrame, remaining_bytes: int) -> DataFrame:
    """Seconds to go at the overall throughput, with its readable form."""
    eta = F.lit(float(remaining_bytes)) * F.sum("seconds") / F.sum("bytes")
    return done.agg(eta.alias("seconds_left")).withColumn("readable", F.expr(P.duration("seconds_left")))


def compression_ratio(metrics: DataFrame) -> DataFrame:
    """Uncompressed over compressed bytes of ``metrics(bytes, compressed_bytes)``."""
    packed = F.sum("compressed_bytes")
    return metrics.agg(F.when(packed > 0, F.sum("bytes") / packed).otherwise(F.lit(1.0)).alias("ratio"))


def top_errors(results: DataFrame, path_col: str = "path", limit: int = 5) -> DataFrame:
    """The first errors by path, and a last row saying how many more there are."""
    errors = results.filter("error IS NOT NULL").select(path_col, "error")
    more = errors.agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(
        F.lit(None).cast("string").alias(path_col),
        F.format_string("... and %d more", F.col("n") - limit).alias("error"))
    return errors.orderBy(path_col).limit(limit).unionByName(more)
