"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of the items, each between two spaces that guard its borders, form one
automaton, which is sent to the tasks.  A text's terms are set one space apart
and streamed through it once; every output is one occurrence of a term, so a
text gives its term counts with no index behind it.  These counts are kept as a
table.  A first pass over it sums up how many documents hold each term, a second
scores: the automaton's outputs map to items, a task adds up an item's terms and
keeps its own ``top`` best documents of each item, and the best of these are
ranked.  No more than ``top`` rows an item and task are moved.

What is sent is bounded: items are taken in blocks of at most ``BLOCK_BYTES`` of
terms and one item more, and each block is searched in all documents.

Rows of one ``item_id`` are one item.  Every row of the documents is a document
of its own, repeated ones too; those without an id come last among equal scores.
Null texts have no terms.  An item without terms, or no documents, gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from logveil.llm.common import LOWER, UPPER, partitions
from logveil.llm.decontaminate import words_of
from logveil.sources.staging import staged

TOP = 10
#: Bytes of the terms that are searched together; an item that is larger makes a block of its own.
BLOCK_BYTES = 4_000_000
#: Scores that a task holds at once.
CELLS = 4_000_000

_COUNTS = "doc_id bigint, n bigint, terms array<int>, tf array<int>"


@dataclass
class Block:
    """Items by number, their terms by number, and for each term the items that hold it and how often."""

    items: list
    terms: list[bytes]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[Row]) -> Block:
        number: dict[bytes, int] = {}
        held: list[list[tuple[int, int]]] = []
        for i, row in enumerate(rows):
            for term, times in row["terms"].items():
                k = number.setdefault(term.encode(), len(number))
                if k == len(held):
                    held.append([])
                held[k].append((i, times))
        flat = np.array([x for h in held for x in h], np.int64).reshape(-1, 2)
        start = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int64)
        return cls([r["item_id"] for r in rows], list(number), start, flat[:, 0].copy(), flat[:, 1].copy())

    def automaton(self):
        """All terms with their guards; texts and terms are read as bytes."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", k)
        found.make_automaton()
        return found


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Block]:
    """All items with a term, block by block."""
    spark = benchmark.sparkSession
    words = (f"regexp_extract_all(translate(coalesce(`{text}`, ''), '{UPPER}', '{LOWER}'), "
             "'[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)")
    terms = benchmark.select(F.col(item).alias("item_id"), F.explode(F.expr(words)).alias("term"))
    counted = terms.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    items = counted.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "times"))).alias("terms"),
                                           F.sum(F.octet_length("term") + 2).alias("bytes"))
    items = staged(items.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(partitions(spark)))), "items")
    base, total = {}, 0
    for row in items.groupBy("bucket").agg(F.sum("bytes").alias("n")).orderBy("bucket").collect():
        base[row["bucket"]], total = total, total + row["n"]
    if not total:
        return
    first = spark.createDataFrame(list(base.items()), "bucket bigint, base bigint")
    before = Window.partitionBy("bucket").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0))).join(F.broadcast(first), "bucket") \
        .withColumn("block", F.floor((F.col("at") + F.col("base")) / BLOCK_BYTES))
    if total > BLOCK_BYTES:
        placed = staged(placed, "item-blocks")
    for k in range(-(-total // BLOCK_BYTES)):
        if rows := placed.where(F.col("block") == k).select("item_id", "terms").collect():
            yield Block.of(rows)


def term_counts(docs: DataFrame, block: Block, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, tf)`` of every document with a term: all its terms, and how often it holds which of the block's."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        output = itemgetter(1)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1)):
                if words := words_of(value.as_py()):
                    found = Counter(map(output, automaton.iter(f" {b' '.join(words).decode('latin-1')} ")))
                    rows.append((key.as_py(), len(words), list(found.keys()), list(found.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _COUNTS)


def weights(counts: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the weight of each of the block's terms."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block_terms.value.terms), np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    block_terms = counts.sparkSession.sparkContext.broadcast(block)
    total = counts.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    found = counts.select("terms").mapInArrow(held, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(block.terms), np.int64)
    for row in found:
        df[row["term"]] = row["df"]
    n = total["N"]
    return n, total["L"] or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The ``top`` best documents of each item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.floor = top, np.ones(items, np.int64)
        self.kept = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, scores: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        """``scores`` of documents by items."""
        floor = self.floor
        if len(scores) > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=0)[-self.top])
        at, item = np.nonzero(scores >= floor)
        new = (item, scores[at, item], missing[at], doc[at])
        item, score, missing, doc = (np.concatenate(x) for x in zip(self.kept, new))
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.empty(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        kept = rank < self.top
        item, score = item[kept], score[order][kept]
        self.kept = (item, score, missing[order][kept], doc[order][kept])
        full = rank[kept] == self.top - 1
        self.floor[item[full]] = score[full]


def _best_of_tasks(counts: DataFrame, block: Block, n_docs: int, n_terms: int, weight: np.ndarray, top: int) -> DataFrame:
    """``(number, doc_id, score)``: the best documents of each item in each task."""
    shared = counts.sparkSession.sparkContext.broadcast((len(block.items), block.start, block.item, block.times, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, start, item, times, weight = shared.value
        best, rows = Best(items, top), max(1, CELLS // items)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 100 - 75 + (75 * batch.column(1).to_numpy() * n_docs) // n_terms
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                scores = np.zeros(batch.num_rows * items, np.int64)
                held = start[term + 1] - start[term]
                # term by term of each document, all the items that hold it
                every = np.repeat(np.arange(len(term)), held)
                at = np.arange(len(every)) - np.repeat(np.cumsum(held) - held, held) + start[term][every]
                np.add.at(scores, row[every] * items + item[at], part[every] * times[at])
                doc = batch.column(0)
                best.add(scores.reshape(-1, items), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
        item, score, missing, doc = best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=missing), pa.array(score, pa.int64())], names=["number", "doc_id", "score"])

    return counts.mapInArrow(run, "number bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0."""
    spark: SparkSession = docs.sparkSession
    kind = benchmark.schema[item].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in blocks(benchmark, item, item_text):
        counts = staged(term_counts(docs, block, doc_id, text), "term-counts")
        n_docs, n_terms, weight = weights(counts, block)
        if not n_docs:
            break
        found = _best_of_tasks(counts, block, n_docs, n_terms, weight, top)
        # first among the tasks of a group, so that no task ranks what all tasks of a large cluster found
        found = found.withColumn("group", F.spark_partition_id() % math.isqrt(partitions(spark)))
        found = _ranked(_ranked(found, top, "number", "group").drop("rank", "group"), top, "number")
        names = spark.createDataFrame(list(enumerate(block.items)), f"number bigint, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
sizes AS (SELECT doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_terms) AS m FROM d, total WHERE len(w) > 0),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM items JOIN tf USING (term) JOIN weight USING (term) JOIN sizes USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}"""
