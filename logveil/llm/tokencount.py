"""Token counts of a piece vocabulary by rank-synchronous merging in arrays.

Distinct pre-tokens of a batch are laid side by side in one array of symbols.  In
each round every pre-token merges its pair of lowest rank, the leftmost of
equals, and all pre-tokens do so at once; after the last round the symbols that
are left are the tokens.  A pre-token of many equal pairs would need a round for
each of them: where a merge cannot give rise to a pair of the same or a lower
rank, all its places in a pre-token are taken in one round, which comes to the
same.

The vocabulary joins no character with a mark of white space after it, so a text
is cut into pre-tokens at spaces.  A character that is no piece counts as its
UTF-8 bytes.  Counts of pre-tokens are remembered by the worker, up to
``REMEMBERED`` of them.  Null and empty texts have no tokens.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import map_batches

#: Tokens beyond which a text is over the limit.
LIMIT = 4096
REMEMBERED = 800_000
#: Symbols that are merged together.
BLOCK = 2_000_000

_MARK = "▁"
_RUNS = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")
_NONE = np.iinfo(np.int64).max


class Merger:
    """Pairs of symbols with their ranks and results, from the pieces of a vocabulary and their scores."""

    def __init__(self, pieces: list[str], scores: list[float], prefix: bool = True) -> None:
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece goes on after a mark of white space: texts cannot be cut there")
        self.number = {p: i for i, p in enumerate(pieces)}
        self.prefix, self.known = prefix, {}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rank = np.array([rank_of[s] for s in scores], np.int64)
        pairs, steady = {}, np.ones(len(pieces), bool)
        for piece, whole in self.number.items():
            for cut in range(1, len(piece)):
                a, b = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * len(pieces) + b] = whole
                    for part in (a, b):
                        if rank[whole] <= rank[part]:
                            steady[part] = False
        self.keys = np.array(sorted(pairs), np.int64)
        self.whole = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.rank, self.steady, self.size = rank, steady, len(pieces)

    @classmethod
    def load(cls, path: str) -> Merger:
        """From a sentencepiece model; pieces that are bytes or control symbols are never merged."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size())
               if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self = cls([model.id_to_piece(i) for i in own], [model.get_score(i) for i in own])
        self.model = model
        return self

    def _pairs(self, symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Result and rank of each symbol with its right neighbour in the same pre-token."""
        whole, rank = np.full(len(symbols), -1), np.full(len(symbols), _NONE)
        if len(symbols) < 2 or not len(self.keys):
            return whole, rank
        a, b = symbols[:-1], symbols[1:]
        key = np.where((of[:-1] == of[1:]) & (a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        whole[hit] = self.whole[at[hit]]
        rank[hit] = self.rank[whole[hit]]
        return whole, rank

    def merge(self, parts: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        total = np.zeros(len(parts), np.int64)
        sizes = np.array([len(p) for p in parts])
        text = "".join(parts)
        number = {c: self.number.get(c, -len(c.encode())) for c in set(text)}
        symbols = np.fromiter(map(number.__getitem__, text), np.int64, len(text))
        of = np.repeat(np.arange(len(parts)), sizes)
        while len(symbols):
            whole, rank = self._pairs(symbols, of)
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least = np.minimum.reduceat(rank, starts)
            widths = np.diff(np.append(starts, len(symbols)))
            done = np.repeat(least == _NONE, widths)
            if done.any():
                np.add.at(total, of[done], np.where(symbols[done] >= 0, 1, -symbols[done]))
                symbols, of, whole, rank = symbols[~done], of[~done], whole[~done], rank[~done]
                least, widths = least[least != _NONE], widths[least != _NONE]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == np.repeat(least, widths))
            token = of[places]
            lead = np.concatenate(([True], token[1:] != token[:-1]))
            # equal ranks of different results only occur among pieces without a rank of their own, which are not steady
            places = places[lead | self.steady[whole[places]]]
            # of overlapping places every second one, from the left
            run = np.concatenate(([0], np.cumsum(np.diff(places) != 1)))
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            places = places[(np.arange(len(places)) - first[run]) % 2 == 0]
            symbols[places] = whole[places]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, of = symbols[keep], of[keep]
        return total

    def _learn(self, parts: set[str]) -> None:
        """Count pre-tokens given without their leading mark."""
        if len(self.known) + len(parts) > REMEMBERED:
            self.known.clear()
        block, size = [], 0
        for part in parts:
            block.append(part)
            size += len(part) + 1
            if size > BLOCK:
                self.known.update(zip(block, self.merge([_MARK + p for p in block]).tolist()))
                block, size = [], 0
        if block:
            self.known.update(zip(block, self.merge([_MARK + p for p in block]).tolist()))

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens without their leading mark; runs of spaces keep their further marks."""
        parts = text.split(" ")
        if "" in parts or _MARK in text:
            parts = [p[1:] for p in _RUNS.findall(_MARK + text.replace(" ", _MARK))]
        return parts

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            parts = self._cut(text)
            try:
                out.append(sum(map(self.known.__getitem__, parts)))
            except KeyError:
                out.append(-1)
        missing = [i for i, n in enumerate(out) if n < 0]
        # what is remembered may be cleared while a block is learnt, so blocks are counted one by one
        block: list[int] = []
        new: set[str] = set()
        for i in chain(missing, [None]):
            if i is not None:
                new.update(set(self._cut(texts[i])).difference(self.known))
                block.append(i)
            if block and (i is None or len(new) > REMEMBERED // 16):
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = set(chain.from_iterable(self._cut(texts[k]) for k in block))
                self._learn(new)
                for k in block:
                    out[k] = sum(map(self.known.__getitem__, self._cut(texts[k])))
                block, new = [], set()
        return out


_mergers: dict[str, Merger] = {}


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row; ``vocabulary`` names a file of ``public_tokenizers``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers

        if vocabulary not in _mergers:
            _mergers[vocabulary] = Merger.load(public_tokenizers.path(vocabulary))
        found = _mergers[vocabulary].counts(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                                          names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text))
    return map_batches(rows, run, "doc_id bigint, n_bytes bigint, n_tokens bigint") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
