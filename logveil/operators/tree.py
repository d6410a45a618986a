"""A whole tree of files in one call: scanned, redacted or copied, written and accounted for."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logveil.functions import files as P
from logveil.functions.rules import Catalogue
from logveil.operators.pseudonyms import CORPUS, DOC
from logveil.operators.redact import counts_map, redact_corpus, redact_documents
from logveil.sources.files import rejected_files, scan_files, text_files, untouched_files
from logveil.sources.staging import staged
from logveil.sources.tree import unseen_files, write_tree

PHASES = "phase string, files bigint, bytes_in bigint, bytes_out bigint, seconds double"


@dataclass
class TreeRun:
    """What a run did.

    ``files`` has ``(path, target, size, written, outcome, counts, error)``, a row
    for each file of the source; ``phases`` has ``(phase, files, bytes_in,
    bytes_out, seconds)`` as the run measured them.
    """

    files: DataFrame
    phases: DataFrame


def timed(phase: str, files: DataFrame, action: Callable[[DataFrame], DataFrame | None]) -> tuple[DataFrame | None, tuple]:
    """Run ``action`` on ``(size, written, …)`` and measure it: its result, and a row of ``PHASES``.

    Numbers come from the rows that the action itself reads, not from another pass.
    """
    seen = Observation()
    counted = files.observe(seen, F.count("*").alias("files"), F.sum("size").alias("bytes_in"), F.sum("written").alias("bytes_out"))
    began = time.monotonic()
    done = action(counted)
    seconds = time.monotonic() - began
    found = seen.get
    return done, (phase, found["files"], found["bytes_in"] or 0, found["bytes_out"] or 0, seconds)


def redact_tree(spark: SparkSession, source: str, target: str, catalogue: Catalogue | None = None, scope: str = DOC,
                unseen: bool = True) -> TreeRun:
    """Write the tree below ``source`` to ``target``: text redacted, as UTF-8, other files as they are, unreadable text not at all.

    With scope ``corpus`` a value has one pseudonym in all files.  A file is a row,
    so it must fit one; ``scan_lines`` and ``redact_lines_scan`` are for larger logs.
    ``unseen=False`` leaves out what Spark's readers do, where only these reach the source.
    """
    catalogue = catalogue or Catalogue.builtin()
    found = scan_files(spark, source)
    if unseen:
        found = found.unionByName(unseen_files(spark, source))
    no_counts = F.expr("cast(map() AS map<string,bigint>)")

    def results(df: DataFrame, outcome: str) -> DataFrame:
        return df.select("path", F.expr(P.sanitized_path("path")).alias("target"), "size", "written", F.lit(outcome).alias("outcome"),
                         "counts", "error")

    texts = text_files(found)
    done = redact_documents(texts, "text", catalogue) if scope == DOC else redact_corpus(texts, "path", "text", catalogue).rows
    done = done.select("path", "size", F.octet_length("text").cast("bigint").alias("written"), F.col("text").cast("binary").alias("content"),
                       F.expr(counts_map()).alias("counts"), F.lit(None).cast("string").alias("error"))
    redacted, redacting = timed("redact", done, lambda df: staged(df, "redacted"))
    _, writing = timed("write", redacted, lambda df: write_tree(spark, df, target))
    copies = untouched_files(found).withColumn("written", F.col("size"))
    _, copying = timed("copy", copies, lambda df: write_tree(spark, df, target))
    rejected = rejected_files(found).select("path", "size", F.lit(0).cast("bigint").alias("written"), "error")
    refused, checking = timed("quarantine", rejected, lambda df: staged(df, "rejected"))
    listed = found.select("path", "size").filter(f"{P.file_class('path')} = 'binary'") \
        .withColumns({"written": F.col("size"), "counts": no_counts, "error": F.lit(None).cast("string")})
    files = results(redacted, "redacted").unionByName(results(listed, "copied")).unionByName(
        results(refused.withColumn("counts", no_counts), "quarantined"))
    return TreeRun(staged(files, "results"), spark.createDataFrame([redacting, writing, copying, checking], PHASES))
