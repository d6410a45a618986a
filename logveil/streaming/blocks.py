"""Redaction of arriving lines in which blocks may go on from batch to batch.

What may still go on at the end of a batch, an open PEM block or the last SQL
statement of a document, is held back with all lines after it, in a carry-over
table, and taken up again with the next batch.  A document is cut only where
nothing is open, so its parts are redacted as the whole would be, with two
differences: the gate of the SQL rule reads the lines that are redacted
together, and a block that is never closed waits for ``BlockRedactor.flush``.

Lines of a document must arrive in order.  Batch *n* reads the carry-over of
batch *n-1* and the dictionary that it left, and overwrites what it
wrote itself, so running it again after a failure gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logveil.functions import text as T
from logveil.functions.rules import Catalogue
from logveil.operators.blocks import PEM_MARKERS, SQL_CONTINUED, SQL_START
from logveil.operators.pseudonyms import CORPUS
from logveil.operators.scan import redact_lines_scan
from logveil.sources.staging import staged
from logveil.streaming.dictionary import DictionaryLog

# The state after a marker: which kinds of block are open, since which line, the
# blocks closed so far, and the line of the last end with the line where its block began.
_START = ("named_struct('private', false, 'certificate', false, 'since', cast(NULL AS bigint), 'closed', cast(NULL AS bigint), "
          "'began', cast(NULL AS bigint), 'spans', cast(array() AS array<struct<first:bigint,last:bigint>>))")
_MARK = ("(s, e) -> transform(array(named_struct('private', IF(e.kind = 'private_key', e.opens, s.private), "
         "'certificate', IF(e.kind = 'certificate' AND NOT s.private, e.opens, s.certificate))), n -> "
         "CASE WHEN (n.private OR n.certificate) AND NOT (s.private OR s.certificate) THEN named_struct('private', n.private, "
         "'certificate', n.certificate, 'since', IF(s.closed <=> e.no, s.began, e.no), 'closed', s.closed, 'began', s.began, 'spans', s.spans) "
         "WHEN (s.private OR s.certificate) AND NOT (n.private OR n.certificate) THEN named_struct('private', false, 'certificate', false, "
         "'since', cast(NULL AS bigint), 'closed', e.no, 'began', s.since, 'spans', concat(s.spans, array(named_struct('first', s.since, 'last', e.no)))) "
         "ELSE named_struct('private', n.private, 'certificate', n.certificate, 'since', s.since, 'closed', s.closed, 'began', s.began, "
         "'spans', s.spans) END)[0]")


def _keyed(lines: DataFrame, doc: str, line_no: str) -> DataFrame:
    return lines.withColumns({"_doc": F.expr(f"coalesce(concat('=', cast(`{doc}` AS string)), '')"),
                              "_no": F.expr(f"coalesce(cast(`{line_no}` AS bigint), 0)")})


def held_from(lines: DataFrame, doc: str, line_no: str, line: str, catalogue: Catalogue) -> DataFrame:
    """``(_doc, _from)``: the documents in which something may go on, and the first line that must wait for it."""
    rows = _keyed(lines, doc, line_no).select("_doc", "_no", F.col("_no").alias("_last"), F.col(line).alias("_line"))
    kinds = {r.category: PEM_MARKERS[r.category] for r in catalogue.text_rules if r.category in PEM_MARKERS}
    opened = None
    if kinds:
        every = "|".join(m for pair in kinds.values() for m in pair)
        events = rows.select("_doc", "_no", F.posexplode(F.expr(f"regexp_extract_all(_line, {T.literal(every)}, 0)")).alias("_pos", "_mark"))
        event = F.struct(F.col("_no").alias("no"), "_pos", F.when(F.col("_mark").contains("CERTIFICATE"), "certificate").otherwise(
            "private_key").alias("kind"), F.col("_mark").startswith("-----BEGIN").alias("opens"))
        opened = events.groupBy("_doc").agg(F.array_sort(F.collect_list(event)).alias("_events")) \
            .select("_doc", F.expr(f"aggregate(_events, {_START}, {_MARK})").alias("_pem"))
        # a line on which a block began ends where the last line does that the block made part of it
        rows = rows.join(opened, "_doc", "left").filter(
            "NOT coalesce(exists(_pem.spans, s -> _no > s.first AND _no <= s.last), false) AND coalesce(_no <= _pem.since, true)") \
            .withColumn("_last", F.expr("coalesce(array_max(transform(filter(_pem.spans, s -> s.first = _no), s -> s.last)), _no)"))
        opened = opened.select("_doc", F.col("_pem.since").alias("_from"))
    if any(r.category == "sql_query" for r in catalogue.text_rules):
        flags = rows.select("_doc", "_no", "_last", F.expr(f"coalesce({T.matches('_line', SQL_START)}, false)").alias("_starts"),
                            F.expr(f"coalesce({T.matches('_line', SQL_CONTINUED)}, false)").alias("_goes_on"))
        # The lines after the last one that ends a statement; one of them must start one.
        ends = flags.groupBy("_doc").agg(
            F.max(F.expr("IF(NOT _starts AND NOT _goes_on, struct(_no, _last), NULL)")).alias("_end"),
            F.max(F.expr("IF(_starts, _no, NULL)")).alias("_begun"), F.min("_no").alias("_first"))
        stated = ends.filter("_begun > coalesce(_end._no, _begun - 1)").select("_doc", F.expr("coalesce(_end._last + 1, _first)").alias("_from"))
        opened = stated if opened is None else opened.unionByName(stated)
    if opened is None:
        return rows.select("_doc", F.col("_no").alias("_from")).limit(0)
    return opened.filter("_from IS NOT NULL").groupBy("_doc").agg(F.min("_from").alias("_from"))


def _carried(spark: SparkSession, carry_path: str, batch_id: int, schema) -> DataFrame:
    """The lines that batch ``batch_id`` held back."""
    return spark.read.schema(schema).parquet(f"{carry_path}/batch={batch_id}")


@dataclass
class BlockRedactor:
    """What a stream does with each batch: take up what was held back, hold back what may go on, redact and write the rest."""

    doc_col: str
    line_no_col: str
    line_col: str
    output_path: str
    dictionary_path: str
    carry_path: str
    scope: str = CORPUS
    catalogue: Catalogue = field(default_factory=Catalogue.builtin)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            batch = batch.unionByName(self._carried(batch.sparkSession, batch_id - 1, batch.schema))
        # a batch may arrive as one file
        lines = staged(batch.repartition(batch.sparkSession.sparkContext.defaultParallelism), "batch")
        since = held_from(lines, self.doc_col, self.line_no_col, self.line_col, self.catalogue)
        split = staged(_keyed(lines, self.doc_col, self.line_no_col).join(since, "_doc", "left").withColumn(
            "_waits", F.coalesce(F.col("_no") >= F.col("_from"), F.lit(False))), "split")
        split.filter("_waits").select(*lines.columns).write.mode("overwrite").parquet(f"{self.carry_path}/batch={batch_id}")
        self._write(split.filter("NOT _waits").select(*lines.columns), batch_id)

    def flush(self, spark: SparkSession, last_batch_id: int, schema: StructType) -> None:
        """After the last batch: redact what it held back, as the end of its documents."""
        self._write(self._carried(spark, last_batch_id, schema), last_batch_id + 1)

    def _carried(self, spark: SparkSession, batch_id: int, schema: StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.carry_path}/batch={batch_id}")

    def _write(self, lines: DataFrame, batch_id: int) -> None:
        log = DictionaryLog(self.dictionary_path)
        known = log.before(lines.sparkSession, batch_id) if self.catalogue.unique_categories else None
        done = redact_lines_scan(lines, self.doc_col, self.line_no_col, self.line_col, self.scope, self.catalogue, known)
        if done.entries is not None:
            log.add(done.entries, batch_id)
        done.rows.write.mode("overwrite").parquet(f"{self.output_path}/batch={batch_id}")


def redact_blocks_stream(lines: DataFrame, redactor: BlockRedactor, checkpoint_path: str, available_now: bool = False) -> StreamingQuery:
    """Start the redaction of a stream of lines."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(redactor)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
