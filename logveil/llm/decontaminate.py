"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over the word sequences of the items and sent to the
tasks.  One holds ``SHARD_WORDS`` words at most: more items make more automata,
of which the driver and a task hold one at a time, with a pass over the texts for
each and the hits of a text united; longer items are cut into parts that overlap
by a window less one word, so no window is lost.  Each text is streamed through,
word by word, keeping the length of the longest match that ends at the word.
Only stretches whose word triples all occur in items are streamed, since a
window cannot leave such a stretch.

Nulls and empty texts have no words and are clean.  Items without words have no
windows.  Items with the same text all count.  Rows are handled one by one, so
repeated rows give repeated results.  Without items, or without texts, every text
is clean.  Texts of any length are streamed as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import LOWER, UPPER, map_batches, unused
from logveil.sources.staging import staged

#: Words of the items in one automaton, which is what is broadcast: some 200 MB of a task.
SHARD_WORDS = 400_000
#: Words of a window; a shorter item is one window as a whole.
WINDOW = 10
#: A text of which more than this share of its words is hit is dropped by ``clean``.
MAX_COVERAGE = 0.8

#: Words in a text as it is; ``_BYTES`` then lower-cases A-Z.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
               for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z lower-cased."""
    return text.encode().translate(_BYTES).split() if text else []


@dataclass
class Automaton:
    """Suffix automaton over word numbers.

    ``full[state]`` holds the items with the window of ``WINDOW`` words that ends
    at the state; ``short[state]`` the shorter items, with their lengths, that end
    there.  ``up[state]`` is the nearest state above that has either.
    """

    window: int
    number: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    full: dict[int, set[str]] = field(default_factory=dict)
    short: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    up: list[int] = field(default_factory=list)
    triples: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    least: int = 0

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """The state for the strings of ``to`` that are no longer than ``at`` and ``word``."""
        if self.length[at] + 1 == self.length[to]:
            return to
        copy = self._state(self.length[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (to := self.step[last].get(word)) is not None:
            return self._split(last, word, to)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.step[at][word])
        return new

    def _holder(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int = WINDOW) -> Automaton:
        self = cls(window)
        rows = [(item, [self.number.setdefault(w, len(self.number)) for w in words_of(text)]) for item, text in items]
        rows = [(item, row) for item, row in rows if row]
        for _, row in rows:
            last = 0
            for word in row:
                last = self._extend(last, word)
        for item, row in rows:
            state = 0
            for i, word in enumerate(row):
                state = self.step[state][word]
                if i + 1 >= window:
                    self.full.setdefault(self._holder(state, window), set()).add(item)
            if len(row) < window:
                self.short.setdefault(self._holder(state, len(row)), []).append((len(row), item))
        self.up = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if above in self.full or above in self.short else self.up[above]
        found = [_triples(np.array(row, np.int64)) for _, row in rows]
        self.triples = np.unique(np.concatenate(found)) if found else self.triples
        self.least = min((min(len(row), window) for _, row in rows), default=0)
        return self

    def _stretches(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Where a window can lie."""
        known = words >= 0
        if self.least >= 3 and len(words) >= 3:
            codes = _triples(words)
            at = np.minimum(np.searchsorted(self.triples, codes), len(self.triples) - 1)
            start = (self.triples[at] == codes) & known[:-2] & known[1:-1] & known[2:]
            known = np.zeros(len(words), bool)
            for shift in range(3):
                known[shift:len(words) - 2 + shift] |= start
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        return [(a, b) for a, b in edge.reshape(-1, 2) if b - a >= self.least]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """``(start, end, items)`` of every occurrence of a window, by end."""
        if len(words) < self.least or not self.least:
            return []
        get = self.number.get
        row = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        found = []
        for a, b in self._stretches(row):
            state = length = 0
            for i, word in enumerate(row[a:b].tolist(), a):
                while state and word not in self.step[state]:
                    state = self.link[state]
                    length = self.length[state]
                if word in self.step[state]:
                    state = self.step[state][word]
                    length += 1
                at = state
                while at > 0:
                    if length >= self.window and at in self.full and self.length[self.link[at]] < self.window:
                        found.append((i + 1 - self.window, i + 1, self.full[at]))
                    for n, item in self.short.get(at, ()):
                        if n <= length:
                            found.append((i + 1 - n, i + 1, {item}))
                    at = self.up[at]
        return found


def _triples(words: np.ndarray) -> np.ndarray:
    """A hash of each three words in a row; equal triples have equal hashes."""
    w = words.astype(np.uint64)
    if len(w) < 3:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]


def spans(matches: list[tuple[int, int, set[str]]]) -> list[tuple[int, int]]:
    """Word ranges that the matches cover together."""
    out: list[list[int]] = []
    for start, end, _ in sorted(matches, key=lambda m: m[:2]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without those word ranges; a line feed stands for each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:places[a][0]].rstrip(" "))
        at = places[b - 1][1]
    return "\n".join([*out, text[at:].lstrip(" ")])


def cleaned(automaton: Automaton, text: str) -> str:
    """``text`` without any occurrence of a window, also such as arise by the removal."""
    while found := spans(automaton.matches(words_of(text))):
        text = without(text, found)
    return text


@dataclass
class Shards:
    """The automata of a table of test items, made one at a time whenever they are gone through."""

    items: DataFrame
    window: int = WINDOW
    most: int = SHARD_WORDS

    def _parts(self) -> Iterator[tuple[str, list[bytes]]]:
        for item, text in self.items.toLocalIterator():
            words = words_of(text)
            for at in range(0, max(1, len(words) - self.window + 1), max(1, self.most - self.window + 1)):
                yield str(item), words[at:at + max(self.most, self.window)]

    def __iter__(self) -> Iterator[Automaton]:
        held, size = [], 0
        for item, words in self._parts():
            if held and size + len(words) > self.most:
                yield Automaton.of(held, self.window)
                held, size = [], 0
            held.append((item, b" ".join(words).decode()))
            size += len(words)
        yield Automaton.of(held, self.window)


def build(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, most: int = SHARD_WORDS) -> Shards:
    """The automata of a table of test items, of ``most`` words each at most."""
    return Shards(benchmark.select(F.col(item).cast("string"), F.col(text)), window, most)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _hit_columns(found: list[tuple[int, list[tuple[int, int]], Iterable[str]]]) -> list[pa.Array]:
    """Columns of ``(n_words, spans, items)`` per row."""
    return [pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([sum(b - a for a, b in ranges) for _, ranges, _ in found], pa.int64()),
            pa.array([[{"start": int(a), "end": int(b)} for a, b in ranges] for _, ranges, _ in found], _SPAN),
            pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string()))]


def _hits(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """``rows`` but for their last column, the text, and their hits by one automaton."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    kept = rows.columns[:-1]
    names = [*kept, "n_words", "n_hit", "spans", "items"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher, out = shared.value, []
        for value in batch.column(len(kept)):
            words = words_of(value.as_py())
            found = matcher.matches(words)
            out.append((len(words), spans(found), set().union(*(m[2] for m in found))))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *_hit_columns(out)], names=names)

    return map_batches(rows, run, "".join(f"`{c}` bigint, " for c in kept) + _HITS)


def _united(rows: DataFrame, shards: Iterable[Automaton]) -> DataFrame:
    """``_hits`` of ``(_row, doc_id, text)`` by all automata, one pass for each; only hits move, not the texts."""
    parts = None
    for number, automaton in enumerate(shards):
        found = _hits(rows, automaton)
        part = staged(found if not number else found.where("n_hit > 0"), "hits")
        parts = part if parts is None else parts.unionAll(part)
    grouped = parts.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(n, spans([(s["start"], s["end"], set()) for s in found]), items)
               for n, found, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        return pa.RecordBatch.from_arrays([batch.column(1), *_hit_columns(out)], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return map_batches(grouped, run, f"doc_id bigint, {_HITS}")


def hits(docs: DataFrame, automata: Iterable[Automaton], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)`` per row; spans are word ranges, items are sorted.

    ``automata`` are gone through more than once; a single one needs no pass but that which the caller starts.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    first, *more = islice(automata, 2)
    if not more:
        return _hits(rows, first)
    return _united(staged(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "texts"), automata)


def clean(docs: DataFrame, automata: Iterable[Automaton], text: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with the hit spans taken out; rows hit beyond ``max_coverage`` are dropped, clean rows are untouched.

    A text of which nothing but white space and punctuation is left is dropped too.
    """
    first, *more = islice(automata, 2)
    if more:
        return _clean_by_shards(docs, automata, text, max_coverage)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def left(value: str | None) -> str | None:
        matcher, words = shared.value, words_of(value)
        ranges = spans(matcher.matches(words))
        if not ranges:
            return value
        if sum(b - a for a, b in ranges) > max_coverage * len(words):
            return None
        rest = cleaned(matcher, value)
        return rest if words_of(rest) else None

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            old = batch.column(at)
            new = pa.array([left(v.as_py()) for v in old], old.type)
            keep = pc.or_(pc.is_valid(new), pc.is_null(old))
            yield pa.RecordBatch.from_arrays(
                [new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _clean_by_shards(docs: DataFrame, automata: Iterable[Automaton], text: str, max_coverage: float) -> DataFrame:
    """``clean`` by several automata: in each round the hits of all are united and taken out, until none is left."""
    row, cut = unused(docs, "_row"), unused(docs, "_cut")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")

    def hit(frame: DataFrame) -> DataFrame:
        found = hits(frame, automata, row, text).where("n_hit > 0")
        return staged(found.select(F.col("doc_id").alias(row), "n_words", "n_hit", F.col("spans").alias(cut)), "hit-rows")

    def run(batches):
        for batch in batches:
            at, place = batch.schema.get_field_index(text), batch.schema.get_field_index(cut)
            new = [without(v.as_py(), [(s["start"], s["end"]) for s in ranges.as_py()]) for v, ranges in zip(batch.column(at), batch.column(place))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns) if i != place],
                schema=pa.schema([f for i, f in enumerate(batch.schema) if i != place]))

    found = hit(rows)
    done = rows.join(found, row, "left_anti")
    found = found.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    while not found.isEmpty():
        rest = staged(rows.join(found.select(row, cut), row).select(*rows.columns, cut).mapInArrow(run, rows.schema), "cut")
        found = hit(rest)
        done = done.unionAll(rest.join(found, row, "left_anti").where(F.col(text).rlike(_WORD.pattern)))
        rows = rest
    return done.drop(row)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS words FROM (
    SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS words FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

