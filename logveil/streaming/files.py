"""Files that arrive in a folder: text redacted, what cannot be read set aside, other files listed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logveil.functions.rules import Catalogue
from logveil.operators.redact import redact_documents
from logveil.sources.files import list_together, rejected_files, relative_path, text_files, untouched_files
from logveil.sources.staging import staged

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def files_together(waiting: int, least: int = 100, batches: int = 20) -> int:
    """How many files to take into a batch so that those that wait are taken up by ``batches`` at most: each costs seconds, whatever it holds."""
    return max(least, -(-waiting // batches))


def arriving_files(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """``(path, size, content)`` of the files that arrive below ``root``."""
    list_together(spark)
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True) \
        .option("maxFilesPerTrigger", files_per_batch).load(root)
    return found.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"), "content")


@dataclass
class FileRouter:
    """What a stream does with each batch of files: three tables, each with a folder for the batch.

    ``redacted`` has ``(path, size, text)``, ``quarantined`` ``(path, size, content, error)`` and ``copied``
    ``(path, size, content)``.  A batch overwrites what it wrote itself, so a batch
    that is run again after a failure adds nothing.
    """

    output_path: str
    catalogue: Catalogue = field(default_factory=Catalogue.builtin)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        files = staged(batch, "files")
        routed = {"redacted": redact_documents(text_files(files), "text", self.catalogue).select("path", "size", "text"),
                  "quarantined": rejected_files(files).select("path", "size", "content", "error"),
                  "copied": untouched_files(files).select("path", "size", "content")}
        for outcome, rows in routed.items():
            rows.write.mode("overwrite").parquet(f"{self.output_path}/{outcome}/batch={batch_id}")


def route_stream(files: DataFrame, router: FileRouter, checkpoint_path: str, available_now: bool = False) -> StreamingQuery:
    """Start the routing of a stream of files."""
    writer = files.writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(router)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
