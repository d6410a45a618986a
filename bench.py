"""Throughput of the headline queries; prints one JSON line.

Inputs are written to a scratch folder first and are not timed.  Mixes are logs
with 0, 0.1, 5 and 50 % sensitive lines in documents of 2 000 lines, as in
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from logveil.functions.rules import Catalogue  # noqa: E402
from logveil.operators.redact import redact_corpus, redact_documents, redact_lines  # noqa: E402
from logveil.operators.scan import redact_lines_scan  # noqa: E402
from logveil.operators.reports import counts_by_document, totals  # noqa: E402
from logveil.plans import views  # noqa: E402
from logveil.sources import synth  # noqa: E402
from logveil.streaming.masks import mask_stream  # noqa: E402

LINES_PER_DOC = 2000


def session(cpus: str) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage(df: DataFrame, path: str, parts: int) -> DataFrame:
    df.repartition(parts).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mixed_docs(spark: SparkSession, sf_dir: str, permille: int) -> DataFrame:
    numbers = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"))
    lines = synth.mixed_lines(numbers, "number", permille)
    return lines.groupBy(F.floor(F.col("number") / (LINES_PER_DOC * 10)).alias("doc_id")) \
        .agg(F.array_join(F.collect_list("line"), "\n").alias("text"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    root = tempfile.mkdtemp(prefix="bench-")
    parts = 2 * int(cpus)
    inputs = {f"mix_{p}": stage(mixed_docs(spark, sf_dir, p), f"{root}/mix_{p}", parts) for p in (0, 1, 50, 500)}
    inputs["documents"] = views.table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts)
    inputs["documents"] = stage(inputs["documents"], f"{root}/documents", parts)
    inputs["pages"] = stage(views.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")),
                            f"{root}/pages", parts)
    inputs["log_docs"] = stage(views.log_docs(spark, sf_dir), f"{root}/log_docs", parts)
    inputs["log_lines"] = stage(views.log_lines(spark, sf_dir), f"{root}/log_lines", parts)

    mixed = synth.mixed_lines(views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number")), "number", 50)
    inputs["mix_50_lines"] = stage(mixed.select(
        F.floor(F.col("number") / (LINES_PER_DOC * 10)).alias("doc_id"), F.col("number").alias("line_no"), "line"), f"{root}/mix_50_lines", parts)

    def redacted(name):
        return lambda: redact_documents(inputs[name], "text").drop("hits")

    queries = {
        "redact_clean": ("mix_0", redacted("mix_0")),
        "redact_sparse": ("mix_1", redacted("mix_1")),
        "redact_mixed": ("mix_50", redacted("mix_50")),
        "redact_dense": ("mix_500", redacted("mix_500")),
        "redact_documents": ("documents", redacted("documents")),
        "redact_pages": ("pages", redacted("pages")),
        "redact_logs_doc": ("log_docs", redacted("log_docs")),
        "count_logs": ("log_docs", lambda: totals(counts_by_document(redact_documents(inputs["log_docs"], "text"), "doc_id"))),
        "redact_logs_corpus": ("log_docs", lambda: redact_corpus(inputs["log_docs"], "doc_id", "text").rows.drop("hits")),
        "redact_lines_doc": ("log_lines", lambda: redact_lines(inputs["log_lines"], "doc_id", "line_no", "line").rows.drop("hits")),
        "redact_lines_scan": ("log_lines", lambda: redact_lines_scan(inputs["log_lines"], "doc_id", "line_no", "line").rows),
        "redact_lines_scan_mixed": ("mix_50_lines", lambda: redact_lines_scan(inputs["mix_50_lines"], "doc_id", "line_no", "line").rows),
        "mask_lines": ("log_lines", lambda: mask_stream(inputs["log_lines"], "line", Catalogue.builtin())),
    }
    size = {}
    for name, df in inputs.items():
        text = "line" if "line" in df.columns else "text"
        size[name] = df.agg(F.sum(F.octet_length(text))).first()[0] / 1e6
    seconds, rates = {}, {}
    for name, (source, build) in queries.items():
        run(build())
        began = time.time()
        run(build())
        seconds[name] = round(time.time() - began, 3)
        rates[name] = round(size[source] / seconds[name], 1)
        print(f"{name}: {seconds[name]} s, {size[source]:.1f} MB, {rates[name]} MB/s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "mb_per_sec": rates, "mb": {k: round(v, 1) for k, v in size.items()}, "cpus": int(cpus), "sf": sf_dir}))


if __name__ == "__main__":
    main()
