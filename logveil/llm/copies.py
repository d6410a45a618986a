"""Exact dedup by a tree merge of sorted digest runs.

Every partition makes one run: an entry for each distinct text, sorted by
digest, with the smallest identifier and the number of rows.  Runs then meet in
binomial rounds.  In a round a partition keeps the entries whose slot has the
same bits as its own number, and hands the others to the partitions whose
numbers differ in just these bits; ``BITS`` rounds of a bit are taken in one
exchange, so a task merges 2^``BITS`` runs.  After the last round all entries of
a text have met.  At every level equal texts become one entry, so a text has at
most one in each run however many copies there are, and no task ever holds more
than a few runs' worth of them.  Runs are merged as streams: a task keeps one
entry of the batch before.

Entries are one only if digest, length and a second hash agree; that is tested
at every level.  The identifier is the id and the place of the row, so of rows
with one id and one text a single one stays.

Texts are compared after each run of ASCII white space became one space; null
counts as empty.  Rows without an id come after all others.  Texts of any length
are read whole.  An empty table gives no rows.  Other columns are not read, and
``drop_copies`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import partitions, unused
from logveil.sources.staging import staged

#: Binomial rounds in one exchange.
BITS = 2
#: A text in more than this share of the rows, of which there are 1000 at most, is broadcast instead of shuffled.
HEAVY_SHARE = 1 / 1000

_KEY = ["digest", "length", "check"]
_RUN = "digest binary, length bigint, check bigint, owner bigint, place bigint, n bigint"


def normal_expr(text: str) -> str:
    """The text with runs of white space as one space; a single space is not touched."""
    return f"regexp_replace(coalesce({text}, ''), '\\\\x20[\\\\x20\\\\x09-\\\\x0D]+|[\\\\x09-\\\\x0D][\\\\x20\\\\x09-\\\\x0D]*', ' ')"


def entries(docs: DataFrame, place: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(digest, length, check, owner, place)`` of each row."""
    return docs.select(F.expr(normal_expr(f"`{text}`")).alias("t"), F.col(doc_id).cast("bigint").alias("owner"), place.alias("place")) \
        .select(F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("bigint").alias("length"),
                F.xxhash64("t").alias("check"), "owner", "place")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each text of a sorted stream: the first, which has the smallest identifier."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
        if held is not None:
            batch = pa.concat_batches([held, batch])
        other = np.zeros(batch.num_rows - 1, bool)
        for name in _KEY:
            column = batch.column(name)
            other |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate(([True], other)))
        n = np.add.reduceat(batch.column("n").to_numpy(), first)
        merged = batch.take(pa.array(first))
        merged = merged.set_column(merged.schema.get_field_index("n"), "n", pa.array(n, pa.int64()))
        yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


def merged_runs(runs: DataFrame) -> DataFrame:
    """One entry for each text, from entries in any order and partitioning."""
    spark = runs.sparkSession
    rounds = max(1, (partitions(spark) - 1).bit_length())
    order = [*_KEY, F.asc_nulls_last("owner"), "place"]
    here = F.pmod(F.spark_partition_id(), F.lit(1 << rounds)).cast("bigint")
    runs = runs.sortWithinPartitions(*order).mapInArrow(_collapse, _RUN)
    for low in range(0, rounds, BITS):
        mask = (1 << min(low + BITS, rounds)) - (1 << low)
        there = here.bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("check").bitwiseAND(F.lit(mask)))
        runs = runs.withColumn("to", there.cast("int")).repartitionById(1 << rounds, "to").drop("to")
        runs = runs.sortWithinPartitions(*order).mapInArrow(_collapse, _RUN)
    return runs


def _decided(rows: DataFrame) -> DataFrame:
    """``rows`` of entries with ``keep_id``, ``keep_place`` and ``group_size``."""
    runs = staged(merged_runs(rows.withColumn("n", F.lit(1).cast("bigint"))), "copies")
    groups = runs.where("n > 1").select(*_KEY, F.col("owner").alias("keep_id"), F.col("place").alias("keep_place"),
                                        F.col("n").alias("group_size"))
    total = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    hot = F.col("group_size") > max(1, total * HEAVY_SHARE)
    heavy, light = groups.where(hot), groups.where(~hot)
    by_heavy = rows.join(F.broadcast(heavy), _KEY)
    by_light = rows.join(F.broadcast(heavy.select(*_KEY)), _KEY, "left_anti").join(light, _KEY, "left")
    alone = F.col("group_size").isNull()
    return by_heavy.unionByName(by_light).withColumns({
        "keep_id": F.when(alone, F.col("owner")).otherwise(F.col("keep_id")),
        "keep_place": F.when(alone, F.col("place")).otherwise(F.col("keep_place")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))})


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of each row."""
    rows = staged(entries(docs, F.monotonically_increasing_id(), doc_id, text), "digests")
    return _decided(rows).select(
        F.col("owner").alias("doc_id"), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    place = unused(docs, "_place")
    docs = staged(docs.withColumn(place, F.monotonically_increasing_id()), "placed")
    rows = staged(entries(docs, F.col(place), doc_id, text), "digests")
    stays = _decided(rows).where("place = keep_place").select(F.col("place").alias(place))
    return docs.join(stays, place, "left_semi").drop(place)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""
