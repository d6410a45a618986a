"""Near-duplicates by ProbMinHash over weighted word shingles.

A document is the multiset of its shingles of ``SHINGLE`` words; a shingle that
occurs k times weighs 1 + ln k.  For each shingle a Poisson process of that rate
sends arrivals to random registers, and every register keeps the shingle of its
first arrival; a process ends as soon as its next arrival is later than the
register that is filled last.  The share of equal registers estimates the
probability Jaccard similarity of two documents.  ``BANDS`` bands of ``ROWS``
registers make buckets, and a pair that shares a bucket is verified on its exact
weighted shingles: it is linked if its probability Jaccard or its plain Jaccard
similarity is ``THRESHOLD`` or more.  Registers are drawn twice, with these weights
and with weight 1, as the two measures part where passages repeat in one copy
only; without repeats both give the same buckets.  Classes are the connected
components.

Documents with the same words are one node, so copies cost a row each and no
pair.  Within a bucket not all pairs are made: nodes meet the most central node
of their buckets first, that is the one with the most companions in all its
buckets, then the smallest, and as classes grow, only nodes outside the class
that holds most of a bucket meet the members of other classes.

Of these last pairs only those are compared whose similarity can reach
``THRESHOLD``.  A shingle is rare if at most ``RARE`` of the nodes in question
have it.  Pairs with rare shingles in common are found, and these shingles
counted, through the shingles themselves; all that other two nodes of a bucket
can share is what is not rare in either, which bounds both similarities.  After
that every two nodes that share a bucket are in one class, have been compared or
cannot be linked, so no link is lost, and ``RARE`` changes the work only.

A text of fewer than ``SHINGLE`` words is one shingle.  Null texts and texts
without words are linked to nothing.  Rows of one id are separate documents that
may have different classes.  A class is named by its smallest id; documents
without an id come last in it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import NO_ID, map_batches, unused
from logveil.llm.decontaminate import words_of
from logveil.sources.staging import dense, staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Characters of text that are sketched together.
CHUNK = 1_000_000
#: Nodes that a rare shingle may have.
RARE = 8
#: Texts whose shingles a verifying worker remembers.
REMEMBERED = 256
#: Documents, or links, that a task which writes keys only should have at least.
DENSE = 4096

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of a text, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(_hashes(pd.util.hash_array(np.array(words, object))), return_counts=True)


def _hashes(words: np.ndarray) -> np.ndarray:
    width = min(SHINGLE, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out ^ words[k:len(words) - width + 1 + k])
    return out


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def sketches(keys: np.ndarray, weight: np.ndarray, of: np.ndarray, number: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle in each register of each of ``number`` texts; ``of`` tells the text of each shingle."""
    first = np.full(number * registers, np.inf)
    holder = np.zeros(number * registers, np.uint64)
    at, turn = np.zeros(len(keys)), np.uint64(0)
    while len(keys):
        turn += np.uint64(1)
        draw = _mix(keys ^ _mix(np.full(1, turn)))
        at = at - np.log1p(-((draw >> np.uint64(11)) / 2.0**53)) / weight
        latest = first.reshape(number, registers).max(axis=1)
        alive = at < latest[of]
        keys, weight, of, at, draw = keys[alive], weight[alive], of[alive], at[alive], draw[alive]
        cell = of * registers + (_mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, at)
        won = first[cell] == at
        holder[cell[won]] = keys[won]
    return holder.reshape(number, registers)


def bands(registers: np.ndarray) -> np.ndarray:
    """A bucket for each band of each text."""
    rows = registers.reshape(len(registers), BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(registers), 1))
    for k in range(ROWS):
        out = _mix(out ^ rows[:, :, k])
    return out.view(np.int64)


def _sketch_chunk(rows: list[list[bytes]]) -> list[np.ndarray]:
    """The buckets of each text by its weighted shingles, and where shingles repeat also by its distinct ones."""
    found = [shingles(words) for words in rows]
    number = lambda some: np.repeat(np.arange(len(some)), [len(k) for k, _ in some])
    out = list(bands(sketches(np.concatenate([k for k, _ in found]), weights(np.concatenate([c for _, c in found])), number(found), len(found))))
    again = [i for i, (_, c) in enumerate(found) if c.max() > 1]
    if again:
        some = [found[i] for i in again]
        keys = np.concatenate([k for k, _ in some])
        for i, plain in zip(again, bands(sketches(keys, np.ones(len(keys)), number(some), len(some)))):
            out[i] = np.unique(np.concatenate([out[i], plain]))
    return out


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, t, node, bands)``: a hash of the text, a digest of its words and its buckets; no node without words."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, buckets, chunk, size = [], [], [], 0

        def flush() -> None:
            if chunk:
                buckets.extend(_sketch_chunk(chunk))
            chunk.clear()

        for value in batch.column(2):
            words = words_of(value.as_py())
            nodes.append(hashlib.md5(b" ".join(words)).digest() if words else None)
            if words:
                chunk.append(words)
                size += sum(map(len, words))
                if size > CHUNK:
                    flush()
                    size = 0
        flush()
        filled = iter(buckets)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()),
             pa.array([None if n is None else next(filled) for n in nodes], pa.list_(pa.int64()))], names=["id", "t", "node", "bands"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), F.col(text))
    return map_batches(rows, run, "id bigint, t bigint, node binary, bands array<bigint>")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Plain and probability Jaccard similarity of two texts, each given by its shingles and their counts."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    wx, wy = weights(x[1]), weights(y[1])
    a, b = wx[i], wy[j]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    above = a[::-1].cumsum()[::-1] + (wx.sum() - a.sum())
    below = b.cumsum() - b + (wy.sum() - b.sum())
    return len(both) / (len(x[0]) + len(y[0]) - len(both)), float((1 / (above / a + below / b)).sum())


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the ``pairs`` ``(a, b)`` whose texts, given as ``(node, text)``, are similar enough."""
    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    known: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def of(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in known:
            known[node] = shingles(words_of(text))
            if len(known) > REMEMBERED:
                known.popitem(last=False)
        known.move_to_end(node)
        return known[node]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        similar = [max(similarity(of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py()))) >= threshold
                   for a, b, ta, tb in zip(*batch.columns)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(similar))

    return map_batches(rows, run, "a binary, b binary")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the ``links`` ``(a, b)``: the smallest node of its component.

    Large-star and small-star steps, each written as a table, until nothing changes.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return least.select("u", F.col("m").alias("v")).unionAll(moved).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = staged(dense(edges, links.count(), DENSE), name)
    before = mark(edges)
    while True:
        edges = staged(dense(small(large(edges).distinct()), before[0], DENSE), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _classed(rows: DataFrame, classes: DataFrame | None, node: str, name: str) -> DataFrame:
    """``rows`` with the class of a node; a node without links is its own."""
    if classes is None:
        return rows.withColumn(name, F.col(node))
    of = classes.select(F.col("node").alias(node), F.col("root").alias(name))
    return rows.join(of, node, "left").withColumn(name, F.coalesce(name, node))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``(node, n, w, keys)`` of ``(node, text)``: the distinct shingles, how many, and their whole weight."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(words_of(v.as_py())) for v in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(k) for k, _ in found], pa.int64()), pa.array([float(weights(c).sum()) for _, c in found]),
             pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64()))], names=["node", "n", "w", "keys"])

    return map_batches(texts, run, "node binary, n bigint, w double, keys array<bigint>")


def _reach(shared: str) -> str:
    """The greatest similarity of nodes a and b that have at most ``shared`` shingles in common, of which each weighs 1 or more."""
    share = [f"least(1D, 1 - (n{x} - ({shared})) / w{x})" for x in "ab"]
    return (f"greatest(({shared}) / (na + nb - ({shared})), "
            f"coalesce({share[0]} * {share[1]} / nullif(1 - (1 - {share[0]}) * (1 - {share[1]}), 0D), 0D))")


def within_reach(mixed: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of ``mixed`` ``(bucket, class, node, top)`` that may be similar enough.

    Of two nodes in one bucket at most one may be of the class ``top``.
    """
    least = threshold - 1e-9
    wanted = texts.join(mixed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = staged(shingle_sets(wanted.select("node", "text")), "sets")
    keys = sets.select("node", F.explode("keys").alias("key"))
    rare = staged(keys.join(keys.groupBy("key").agg(F.count("*").alias("df")).where(f"df <= {RARE}"), "key"), "rare")
    nodes = sets.select("node", "n", "w").join(rare.groupBy("node").agg(F.count("*").alias("r")), "node", "left")
    nodes = nodes.join(mixed.select("node", "class").distinct(), "node").select(
        "node", "class", "n", "w", (F.col("n") - F.coalesce("r", F.lit(0))).alias("c"))
    nodes = staged(nodes, "reach")
    of = lambda rows, x: rows.select(*[F.col(c).alias({"node": x, "bucket": c}.get(c, c + x)) for c in rows.columns])

    several = rare.where("df > 1").select("key", "node")
    meeting = several.select("key", F.col("node").alias("a")).join(several.select("key", F.col("node").alias("b")), "key") \
        .where("a < b").groupBy("a", "b").agg(F.count("*").alias("s"))
    near = meeting.join(of(nodes, "a"), "a").join(of(nodes, "b"), "b").where("classa <> classb") \
        .where(f"{_reach('least(ca, cb) + s')} >= {least}").select("a", "b")

    able = nodes.where(f"greatest(c / n, 1 - (n - c) / w) >= {least}").drop("class")
    placed = mixed.join(able, "node")
    far = of(placed.where("class <> top").drop("top"), "a").join(of(placed.drop("top"), "b"), "bucket").where("classa <> classb") \
        .where(f"{_reach('least(ca, cb)')} >= {least}").select("a", "b")
    return near.unionAll(far)


class _Rounds:
    """Pairs compared and links found so far, among the texts of ``number`` documents."""

    def __init__(self, texts: DataFrame, number: int) -> None:
        self.texts, self.number = texts, number
        self.compared: DataFrame | None = None
        self.links: DataFrame | None = None
        self.classes: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> None:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.compared is not None:
            ordered = ordered.join(self.compared, ["a", "b"], "left_anti")
        ordered = staged(dense(ordered, self.number, DENSE), "pairs")
        if ordered.isEmpty():
            return
        found = staged(dense(verify(ordered, self.texts), self.number, DENSE, moved=True), "links")
        self.compared = ordered if self.compared is None else self.compared.unionAll(ordered)
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionAll(found)
            self.classes = components(self.links)

    def apart(self, rows: DataFrame, a: str, b: str) -> DataFrame:
        """``(a, b)`` of the rows where these are in different classes."""
        two = _classed(_classed(rows.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), self.classes, "a", "ca"), self.classes, "b", "cb")
        return two.where("ca <> cb").select("a", "b")


def _one_each(texts: DataFrame) -> DataFrame:
    """One of the equal rows of each node of the staged ``(node, text)``; texts are moved only for nodes with several."""
    several = staged(texts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "several")
    if several.isEmpty():
        return texts
    return staged(texts.join(several, "node", "left_anti").unionAll(texts.join(several, "node", "left_semi").dropDuplicates(["node"])), "texts-once")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, t, class_id, class_size, root)`` per row.

    Its id, its text's hash, the smallest id of its class, the number of documents
    of that, and what names the class where ids are missing: null without words.
    """
    drawn = staged(sketch(docs, doc_id, text), "sketches")
    number = drawn.count()
    keyed = lambda rows, name: staged(dense(rows, number, DENSE), name)
    nodes = keyed(drawn.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("id", "t")).alias("first"), F.count("*").alias("n")), "nodes")
    first = nodes.select("node", "first.id", "first.t")
    hashed = drawn.select("node", "id", "t", "bands").join(first, ["node", "id", "t"]) \
        .select("node", F.explode("bands").alias("bucket")).distinct()
    shared = hashed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")) \
        .where("lo < hi").drop("hi")
    members = keyed(hashed.join(shared, "bucket"), "members")
    ranked = members.join(members.groupBy("node").agg(F.sum("size").alias("rank")), "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("hub"))
    members = keyed(members.drop("size").join(hubs, "bucket"), "hubs")
    wanted = members.select("node").distinct().join(first, "node")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    rounds = _Rounds(_one_each(staged(rows.join(wanted, ["id", "t"]).select("node", "text"), "texts")), number)

    best = members.groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    rounds.compare(best.where("a <> b"))
    rounds.compare(rounds.apart(members.select(F.col("hub.node").alias("hub"), "node"), "hub", "node"))
    rounds.compare(rounds.apart(members, "lo", "node"))
    classed = _classed(members.select("bucket", "node"), rounds.classes, "node", "class").distinct()
    most = classed.groupBy("bucket", "class").count().groupBy("bucket").agg(
        F.max(F.struct("count", "class")).alias("top"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("top.class").alias("top"))
    mixed = keyed(classed.join(most, "bucket"), "mixed")
    rounds.compare(within_reach(mixed, rounds.texts))

    named = _classed(nodes, rounds.classes, "node", "root")
    totals = named.groupBy("root").agg(F.min("first.id").alias("class_id"), F.sum("n").alias("class_size"))
    named = named.select("node", "root").join(totals, "root")
    return drawn.select("id", "t", "node").join(named, "node", "left").select(
        "id", "t", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "root")


def digest(classes: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return classes.select(real("id").alias("doc_id"), real("class_id").alias("class_id"), "class_size")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, of equal rows any.

    Rows without words are all kept.
    """
    key, row, times = (unused(docs, n) for n in ("_id", "_row", "_times"))
    best = near_duplicates(docs, doc_id, text).groupBy("root", "id", "t").agg(F.count("*").alias("times"))
    first = best.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "t", "times")).alias("first")).select("first.*")
    bare = best.where("root IS NULL").select("id", "t", F.lit(1).cast("bigint").alias("times"))
    keep = staged(first.unionAll(bare), "kept")
    named = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))).withColumn(row, F.xxhash64(text))
    kept = named.join(keep.select(F.col("id").alias(key), F.col("t").alias(row), F.col("times").alias(times)), [key, row])
    if not keep.where("times > 1").isEmpty():
        kept = staged(kept, "repeated")
        kept = kept.where(F.col(times) == 1).unionByName(kept.where(F.col(times) > 1).dropDuplicates([key, row]))
    return kept.select(*docs.columns)
