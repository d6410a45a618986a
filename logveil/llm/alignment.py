"""Alignment of two tokenizers by diagonal run skipping, with link counts over the corpus.

Tokens of a text end at byte offsets, which rise in both tokenisations.  Where
both end, a group ends.  Most groups have one token of each kind, so the two
lists of ends are equal for long stretches at one shift of index: they are
compared at the current shift in slices of 1, 2, 4, ... tokens, the slice that
differs is halved down to the first difference, and the whole stretch is jumped.
The irregular group after it is resolved token by token and sets the new shift.

A group links each of its A tokens to each of its B tokens.  Of large groups
only distinct ids with their numbers are paired.  A text gives its distinct id
pairs; a pair's count is the number of texts that hold it.  Counts of at most
``FREQUENT`` pairs, those above a power of two, are sent to the tasks that read
the links; the rarer ones are joined by a shuffle, in which no key has more rows
than that power.

A is a byte-level vocabulary, given as ranks; B a sentencepiece model that puts a
space before the text.  Null and empty texts, and those which a tokenizer does
not give back byte for byte, have no tokens.  Texts of any length are read
whole.  Rows are documents, repeated ones too.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.sources.staging import staged

#: Pairs whose counts are broadcast, 16 bytes each.
FREQUENT = 1 << 20
#: Links of a group from which on only distinct ids are paired.
LARGE = 4096
#: Parts that a task remembers, their characters together, and texts that it takes together.
REMEMBERED, REMEMBERED_CHARACTERS, TOGETHER = 200_000, 10_000_000, 1024

#: Spaces with white space beside them, or at an end; and the others, at which texts are cut.
_WIDE = re.compile(r"\s | \s|^ | \Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")

_ALIGNED = ("place bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
            "pairs array<bigint>, times array<bigint>")


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and tokens as text with what may follow them."""

    def __init__(self, ranks: str, model: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as lines:
            number = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("A", pat_str=public_tokenizers.PATTERN, mergeable_ranks=number, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.bytes_a = [b""] * (max(number.values()) + 1)
        for token, rank in number.items():
            self.bytes_a[rank] = token
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        if any(" " in t.lstrip(b" ").decode("latin-1") for t in self.bytes_b):
            raise ValueError("a piece goes on after a space: texts cannot be cut there")
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.spelled = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;\n"]

    def exact(self, text: str, b: list[int]) -> bool:
        """Whether both tokenizers give a text back."""
        whole = b" " + text.encode()
        return b"".join(map(self.bytes_b.__getitem__, b)) == whole and b"".join(map(self.bytes_a.__getitem__, self.a.encode_ordinary(" " + text))) == whole


@cache
def vocabularies(ranks: str, model: str) -> Vocabularies:
    return Vocabularies(ranks, model)


def inner_tokens(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens that do not end a group, of both; ``a`` and ``b`` are rising ends with the same last one."""
    inner_a, inner_b = [], []
    i, shift, last = 0, 0, len(a)
    while i < last:
        step = 1
        while i < last and a[i:i + step] == b[i + shift:i + shift + step]:
            i += step
            step *= 2
        if i >= last:
            break
        while step > 1:
            step //= 2
            if a[i:i + step] == b[i + shift:i + shift + step]:
                i += step
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                inner_a.append(i)
                i += 1
                x = a[i]
            else:
                inner_b.append(j)
                j += 1
                y = b[j]
        i += 1
        shift = j + 1 - i
    return inner_a, inner_b


def _crossed(first: np.ndarray, n: np.ndarray, other_first: np.ndarray, other_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both tokens of every link, for groups with ``n`` tokens from ``first`` on and ``other_n`` from ``other_first`` on."""
    links = n * other_n
    of = np.repeat(np.arange(len(n)), links)
    at = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links)
    return first[of] + at // other_n[of], other_first[of] + at % other_n[of]


class Alignment:
    """Groups of two token sequences with the same last end: for each, how many tokens it has of A and of B."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        self.a, self.b = a, b
        self.closing = []
        for tokens, held in zip((a, b), inner_tokens(ends_a.tolist(), ends_b.tolist())):
            closes = np.ones(len(tokens), bool)
            closes[held] = False
            self.closing.append(closes)
        self.last_a, self.last_b = map(np.flatnonzero, self.closing)
        self.n_a, self.n_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)

    def links(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(group, pair, times)`` by group: id pairs ``a * base + b``, and how many links have them; pairs may repeat."""
        links = self.n_a * self.n_b
        single, large = links == 1, links > LARGE
        few = ~(single | large)
        groups = [np.flatnonzero(single), np.repeat(np.flatnonzero(few), links[few])]
        i, j = _crossed(self.last_a[few] + 1 - self.n_a[few], self.n_a[few], self.last_b[few] + 1 - self.n_b[few], self.n_b[few])
        pairs = [self.a[self.last_a[single]] * base + self.b[self.last_b[single]], self.a[i] * base + self.b[j]]
        times = [np.ones(len(p), np.int64) for p in pairs]
        for g in np.flatnonzero(large):
            a, x = np.unique(self.a[self.last_a[g] + 1 - self.n_a[g]:self.last_a[g] + 1], return_counts=True)
            b, y = np.unique(self.b[self.last_b[g] + 1 - self.n_b[g]:self.last_b[g] + 1], return_counts=True)
            pairs.append((a[:, None] * base + b).ravel())
            times.append((x[:, None] * y).ravel())
            groups.append(np.full(len(pairs[-1]), g))
        group = np.concatenate(groups)
        order = np.argsort(group, kind="stable")
        return group[order], np.concatenate(pairs)[order], np.concatenate(times)[order]

    def spelled(self, words: list[str], last: np.ndarray) -> str:
        """The ids in order of groups, A before B: ``,`` within, ``|`` between, ``;`` after a group, a line feed after groups in ``last``."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        group_a, group_b = (np.cumsum(c) - c for c in self.closing)
        before_b = np.concatenate(([0], self.last_b + 1))
        out[np.arange(len(self.a)) + before_b[group_a]] = self.a * 4 + self.closing[0]
        out[np.arange(len(self.b)) + self.last_a[group_b] + 1] = self.b * 4 + 2 * self.closing[1]
        out[self.last_a[last] + self.last_b[last] + 1] += 1
        return "".join(map(words.__getitem__, out.tolist()))


def united(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their links."""
    order = np.argsort(pairs)
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(times, first)


class Parts:
    """Alignments of parts of texts, remembered while a task runs.

    Neither tokenizer looks across a space without white space beside it, so both
    end a token before each and texts can be cut there.  The parts that are new in a block of texts are
    laid end to end and aligned as one sequence.
    """

    def __init__(self, both: Vocabularies) -> None:
        self.both, self.base = both, len(both.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.spelled: list[str] = []
        #: tokens of A and of B, groups, whether a tokenizer does not give the part back, and where its links are
        self.sizes = np.empty((0, 6), np.int64)
        self.pairs = self.times = np.empty(0, np.int64)
        self.characters = 0

    def _keep(self, parts: list[str], spelled: list[str], *sizes: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.spelled), len(self.spelled) + len(parts))))
        self.spelled += spelled
        self.sizes = np.concatenate((self.sizes, np.stack(sizes, axis=1)))
        self.characters += sum(map(len, parts))

    def _learn(self, parts: list[str]) -> None:
        both = self.both
        line = " " + " ".join(parts)
        whole, ids_b = line.encode(), both.b.encode(parts, num_threads=1)
        a = both.a.encode_to_numpy(line, disallowed_special=()).astype(np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        if b"".join(map(both.bytes_b.__getitem__, b.tolist())) != whole or b"".join(map(both.bytes_a.__getitem__, a.tolist())) != whole:
            exact = [both.exact(p, ids) for p, ids in zip(parts, ids_b)]
            if not all(exact):
                odd = [p for p, e in zip(parts, exact) if not e]
                none = np.zeros(len(odd), np.int64)
                self._keep(odd, [""] * len(odd), none, none, none, none + 1, none, none)
                if parts := [p for p, e in zip(parts, exact) if e]:
                    self._learn(parts)
                return
        ends_a, ends_b = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])
        found = Alignment(a, b, ends_a, ends_b)
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        size = lambda x: np.diff(np.searchsorted(x, ends), prepend=-1)
        groups = size(ends_a[found.last_a])
        last = np.cumsum(groups) - 1
        group, pairs, times = found.links(self.base)
        links = np.diff(np.searchsorted(group, last, side="right"), prepend=0)
        first = len(self.pairs) + np.cumsum(links) - links
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))
        spelled = found.spelled(both.spelled, last).split("\n")[:-1]
        self._keep(parts, spelled, size(ends_a), size(ends_b), groups, np.zeros(len(parts), np.int64), first, links)

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """``(n_a, n_b, n_groups, n_links, groups, pairs, times)`` of each text."""
        cut = [() if not t else _CUT.split(t) if _WIDE.search(t) else t.split(" ") for t in texts]
        if len(self.number) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.clear()
        if new := set(chain.from_iterable(cut)).difference(self.number):
            self._learn(list(new))
        for parts in cut:
            at = list(map(self.number.__getitem__, parts))
            rows = self.sizes[at]
            n_a, n_b, n_groups, odd = rows[:, :4].sum(axis=0).tolist()
            if odd or not at:
                yield 0, 0, 0, 0, "", (), ()
                continue
            links = rows[:, 5]
            held = np.arange(int(links.sum())) + np.repeat(rows[:, 4] - np.cumsum(links) + links, links)
            pairs, times = united(self.pairs[held], self.times[held])
            yield n_a, n_b, n_groups, int(times.sum()), ";".join(map(self.spelled.__getitem__, at)), pairs, times


def aligned(docs: DataFrame, ranks: str, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(place, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` of each row, with ``groups`` spelled out."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parts(vocabularies(ranks, model))
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                columns = [pa.array(c, t) for c, t in zip(zip(*known.aligned(batch.column(2).to_pylist())), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame, base: int) -> DataFrame:
    """``(pair, n, best)``: the texts that hold a pair, and whether no other pair of its A id is in more."""
    counts = staged(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.floor(F.col("pair") / base)
    # one row for each id of the vocabulary at most
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _cut(counts: DataFrame) -> tuple[int, int]:
    """The least power of two that at most ``FREQUENT`` counts reach, and how many counts do not reach it."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    power, held = 63, 0
    for row in sizes:
        if held + row["count"] > FREQUENT:
            break
        power, held = row["power"], held + row["count"]
    return 2 ** power if held else 2 ** 62, sum(r["count"] for r in sizes) - held


def align(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", model: str = "piece_bpe_32k.model",
          doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row, and ``groups`` if wished."""
    found = aligned(docs, ranks, model, doc_id, text)
    found = found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    rows = staged(found if keep_groups else found.drop("groups"), "aligned")
    base = _base(model)
    counts = staged(pair_counts(rows, base), "pair-counts")
    least, rare = _cut(counts)
    linked = rows.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("link")) \
        .select("place", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    met = linked.join(frequent, "pair")
    if rare:
        others = linked.join(frequent.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < least), "pair")
        met = met.unionByName(others)
    sums = met.groupBy("place").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "place", "left").drop("place") \
        .fillna(0, ["n_best", "count_sum"])


def _base(model: str) -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model)).get_piece_size()


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
