"""Packing of tokenised documents into sequences by a linear grouping scheme.

A length is at most ``CAPACITY``, so the whole corpus is planned on its
histogram of lengths, whatever its size:

1. Lengths above a share of the capacity are sorted and cut into groups of equal
   cardinality; every length is rounded up to the largest of its group, which
   leaves few sizes.
2. Configurations of these sizes, that is all multisets that fit, are chosen
   fullest first, each as often as the numbers left allow.
3. Actual lengths take the places, longest first within a group.  What rounding
   up had reserved becomes free.
4. The small lengths go, longest first, to the sequence that they fill best;
   new sequences are opened only when none has room.

Sequences with the same contents are kept as one range of numbers, so a plan
has a few thousand slots: a length, a range of ranks among the documents of
that length, and the sequences and offset where they go.  Documents get their
rank by a window over (length, salt) and look up their slot in the broadcast
plan.

A null or empty text is one piece holding the end token alone.  Rows without an
id are packed too.  Equal rows are separate documents.  An empty table gives no
pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.llm.common import map_batches, partitions
from logveil.sources.staging import staged

CAPACITY = 4096
END = 1
#: Lengths above a share of the capacity are grouped, into that many groups; of these schemes the best is taken.
SCHEMES = ((0.2, 10), (0.2, 20), (0.25, 16), (0.25, 32), (0.33, 24), (0.33, 60), (0.5, 100))
#: Rows that one window task ranks, on average at most.
RANKED = 1_000_000
#: Bytes of the parts of text whose ids a task remembers, and what an entry takes besides its part and ids.
REMEMBERED_BYTES, ENTRY_BYTES = 96_000_000, 180

_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_MARKS = {".", ","}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


@lru_cache(maxsize=1)
def _loaded(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, once in a process: reused workers kept some megabytes of each one they loaded."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class Encoder(dict):
    """Ids of whole texts, as little-endian 32-bit integers; as a dictionary it remembers the parts met.

    This vocabulary's tokenizer lower-cases, drops white space and looks across
    neither white space nor the border between a letter and a full stop or comma.
    So the ids of a text are those of its parts, which repeat.  A part of Latin
    letters goes to the model at once, any other through the whole tokenizer, and
    so does a text that may hold a special string.  The tokenizer stays with the
    process, the parts go with the task.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.bytes = 0
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = _loaded(path)
        self.model = self.tokenizer.model
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if self.bytes > REMEMBERED_BYTES:
            self.clear()
            self.bytes = 0
        if _LETTERS(part):
            word = part if part.isascii() else part.lower().translate(self.spelling)
            ids = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
        elif part[-1:] in _MARKS and _LETTERS(part[:-1]):
            ids = self[part[:-1]] + self[part[-1]]
        else:
            ids = self._whole(part)
        self[part] = ids
        self.bytes += len(part) + len(ids) + ENTRY_BYTES
        return ids

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            return self._whole(text)
        parts = text.replace("\n", " ").encode().translate(_LOWER).decode().split(" ")
        return b"".join(map(self.__getitem__, parts))


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)``: documents cut at ``CAPACITY`` tokens.

    ``tokenizer`` names a vocabulary file of ``public_tokenizers``, which every worker has.
    """
    end = np.array([END], "<u4").tobytes()

    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(value.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at:at + 4 * CAPACITY]
                    rows.append((key.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, _PIECES)


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Lengths with their numbers, longest first, as groups of equal cardinality."""
    total, out, taken = sum(n for _, n in large), [[]], 0
    each = max(1, -(-total // groups))
    for length, n in large:
        while n:
            part = min(n, each - taken)
            out[-1].append([length, part])
            taken, n = taken + part, n - part
            if taken == each:
                out.append([])
                taken = 0
    return [g for g in out if g]


def _configurations(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Multisets of size numbers that fit, fullest first."""
    most = capacity // min(sizes) if sizes else 0
    found = [c for k in range(1, most + 1) for c in combinations_with_replacement(range(len(sizes)), k)
             if sum(sizes[i] for i in c) <= capacity]
    return sorted(found, key=lambda c: (-sum(sizes[i] for i in c), len(c), c))


Slot = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> list[Slot]:
    """Slots ``(length, first rank, number, first sequence, offset)`` for that many documents of each length.

    A document of rank ``first rank + i`` goes to ``first sequence + i``.
    """
    return min((_plan(histogram, capacity, large, groups) for large, groups in schemes), key=lambda x: x[0])[1]


def _plan(histogram: dict[int, int], capacity: int, large: float, groups: int) -> tuple[int, list[Slot]]:
    """The number of sequences, and the slots."""
    order = sorted(((length, n) for length, n in histogram.items() if n), reverse=True)
    slots: list[Slot] = []
    ranks: dict[int, int] = defaultdict(int)
    sequences = 0
    #: free room -> ranges (first sequence, number) that have it
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    free: list[int] = []

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if not room[space]:
                insort(free, space)
            room[space].append((first, n))

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        slots.append((length, ranks[length], n, sequence, offset))
        ranks[length] += n

    queues = _grouped([x for x in order if x[0] > large * capacity], groups)
    left = [sum(n for _, n in q) for q in queues]
    for configuration in _configurations([q[0][0] for q in queues], capacity):
        need = {g: configuration.count(g) for g in set(configuration)}
        times = min(left[g] // k for g, k in need.items())
        if not times:
            continue
        ranges = [(sequences, times, 0)]
        sequences += times
        for g in configuration:
            left[g] -= times
            filled = []
            for first, n, used in ranges:
                while n:
                    length, there = queues[g][0]
                    part = min(n, there)
                    put(length, part, first, used)
                    filled.append((first, part, used + length))
                    queues[g][0][1] -= part
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                    first, n = first + part, n - part
            ranges = filled
        for first, n, used in ranges:
            give(capacity - used, first, n)
    for length, n in (x for x in order if x[0] <= large * capacity):
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                new = -(-n // (capacity // length))
                give(capacity, sequences, new)
                sequences += new
                continue
            space = free[at]
            first, there = room[space].pop()
            if not room[space]:
                free.pop(at)
            each = min(space // length, n)
            # as a best fit fills one sequence after another, each of these takes the length as often as it has room
            part = min(there, n // each)
            for k in range(each):
                put(length, part, first, capacity - space + k * length)
            n -= each * part
            give(space - each * length, first, part)
            give(space, first + part, there - part)
    return sequences, slots


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; it needs ``doc_id``, ``piece``, ``length`` and ``ids_crc32``.

    ``cut`` is read twice, so it should be a table, not a computation.  Columns
    with the two names are replaced.
    """
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    total = cut.count()
    salts = max(partitions(spark), -(-total // RANKED))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    counts = cut.groupBy("length", salt.alias("salt")).count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = sorted(plan(histogram, capacity))
    first = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*slots)) if slots else ())
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(base.select("length", F.col("salt").alias("_salt"), "base"), ["length", "_salt"]) \
        .withColumn("_rank", F.col("_rank") + F.col("base")).drop("base", "_salt").select(*cut.columns, "_rank")
    names = cut.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, start, _, sequence, offset = first.value
        size = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
        rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
        top = int(start.max()) + int(rank.max()) + 1
        at = np.searchsorted(length * top + start, size * top + rank, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sequence[at] + rank - start[at], pa.int64()), pa.array(offset[at], pa.int64())],
            names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return map_batches(ranked, run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the ids of each sequence, at most ``CAPACITY`` of them, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.expr("aggregate(parts, binary(''), (a, p) -> a || p.ids)").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", keep_ids: bool = True) -> DataFrame:
    """Every piece of ``docs`` with its place."""
    cut = pieces(docs, tokenizer, keep_ids=keep_ids)
    return pack(staged(cut if keep_ids else cut.drop("ids"), "pieces"))


def digest(packed: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
