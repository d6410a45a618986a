"""Redaction of arriving lines, with pseudonyms that stay the same from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logveil.functions import files as P
from logveil.functions.rules import Catalogue
from logveil.operators.pseudonyms import CORPUS, readable
from logveil.operators.redact import redact_lines
from logveil.sources.staging import staged


def known_entries(spark: SparkSession, dictionary_path: str, before: int | None = None) -> DataFrame | None:
    """Dictionary entries of the batches before ``before``; none if there is no dictionary yet."""
    try:
        entries = spark.read.parquet(dictionary_path)
    except AnalysisException:
        return None
    return (entries if before is None else entries.filter(F.col("batch") < before)).drop("batch")


def read_dictionary(spark: SparkSession, dictionary_path: str) -> DataFrame:
    """The dictionary so far: ``(scope, category, original, id, replacement)``."""
    entries = known_entries(spark, dictionary_path)
    if entries is None:
        return spark.createDataFrame([], "scope string, category string, original string, id bigint, replacement string")
    return readable(entries)


def batch_redactor(doc_col: str, line_no_col: str, line_col: str, output_path: str, dictionary_path: str,
                   scope: str = CORPUS, catalogue: Catalogue | None = None,
                   blocks: bool = True) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: extend the dictionary, then write the redacted lines.

    A batch reads only entries of earlier batches and overwrites what it wrote
    itself, so running one again after a failure gives the same result.
    Blocks are recognised where their lines arrive in the same batch.
    """
    def redact_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = known_entries(spark, dictionary_path, batch_id)
        lines = staged(batch, "batch")
        done = redact_lines(lines, doc_col, line_no_col, line_col, scope, catalogue, known, blocks)
        if done.entries is not None:
            done.entries.write.mode("overwrite").parquet(f"{dictionary_path}/batch={batch_id}")
        done.rows.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")
    return redact_batch


def redact_stream(lines: DataFrame, doc_col: str, line_no_col: str, line_col: str, output_path: str,
                  dictionary_path: str, checkpoint_path: str, available_now: bool = False,
                  **options) -> StreamingQuery:
    """Start the redaction of a stream of lines; ``options`` as for ``batch_redactor``."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(
        batch_redactor(doc_col, line_no_col, line_col, output_path, dictionary_path, **options))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_error(files: DataFrame) -> DataFrame:
    """Files as ``(path, size, content, text, error)``; the text is missing where there is an error."""
    bad = P.decoding_error("content")
    return files.withColumn("error", F.expr(bad)) \
        .withColumn("text", F.expr(f"CASE WHEN error IS NULL THEN {P.decoded('content')} END"))


def quarantine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable files as text, and the others with the reason: never passed on unredacted."""
    checked = with_error(files)
    return (checked.filter("error IS NULL").drop("error", "content"),
            checked.filter("error IS NOT NULL").drop("text"))
