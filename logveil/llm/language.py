"""Language identification by word-first backoff.

A word that is known adds, for each language, the logarithm of its smoothed
frequency there.  An unseen word is taken apart: at each place the longest known
n-gram of its characters is scored and skipped, from ``NGRAM`` characters down
to one.  The score is the posterior of the best language, its log odds divided
by ``TEMPERATURE``, as words are not independent.

Counts cover all texts that are learned from.  Words are counted per language
in Spark; n-grams are counted from the distinct words and their numbers.  A word
or n-gram is known if its share in some language is ``WORD_SHARE`` or
``NGRAM_SHARE`` or more.  Where that makes more than ``CELLS`` shares in all, or
more than ``UNITS`` words or n-grams, the least share rises until they fit: what
is broadcast is bounded whatever the corpus and the number of languages.

A word is a run of letters, in lower case.  Null texts and texts without letters
are ``und`` with score 0.  Without anything to learn from, so are all texts.
Equal scores go to the language that sorts first.  Rows with a null or empty
language teach nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import held_out, map_batches
from logveil.sources.staging import staged

UNKNOWN = "und"
WORD_SHARE, NGRAM_SHARE = 2e-5, 2e-6
NGRAM = 4
#: Share that a language gives to what it does not know.
FLOOR = 1e-7
TEMPERATURE = 8.0
#: Bounds of each broadcast table: shares, of 8 bytes, one for each unit and language, and units.
CELLS, UNITS = 1 << 23, 500_000
#: Distinct words that a worker counts before it passes them on; it remembers four times as many scores of unseen words.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(word: str) -> list[str]:
    """All n-grams of a word; its ends are marked."""
    marked = f"^{word}$"
    return [marked[i:i + n] for n in range(1, NGRAM + 1) for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log shares per language of known words and n-grams, as rows of one matrix; the last row is for what is unknown."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    def __post_init__(self) -> None:
        self.unseen: dict[str, int] = {}
        self.scored = np.empty((0, len(self.languages)))

    def backoff(self, word: str) -> np.ndarray:
        """Log shares of an unseen word."""
        marked, at, rows = f"^{word}$", 0, []
        while at < len(marked):
            for n in range(min(NGRAM, len(marked) - at), 0, -1):
                row = self.grams.get(marked[at:at + n])
                if row is not None:
                    rows.append(row)
                    at += n
                    break
            else:
                rows.append(len(self.logs) - 1)
                at += 1
        return self.logs.take(rows, axis=0).sum(axis=0) / len(rows)

    def _remembered(self, word: str) -> int:
        """The row of ``scored`` that holds an unseen word."""
        row = self.unseen.get(word)
        if row is None:
            row = self.unseen[word] = len(self.unseen)
            if row >= len(self.scored):
                self.scored = np.concatenate([self.scored, np.empty((max(1024, len(self.scored)), len(self.languages)))])
            self.scored[row] = self.backoff(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        if len(self.unseen) * len(self.languages) >= 4 * REMEMBERED:
            self.unseen.clear()
            self.scored = self.scored[:0]
        known = [(self.words[w], n) for w, n in counts.items() if w in self.words]
        unseen = [(self._remembered(w), n) for w, n in counts.items() if w not in self.words]
        total = np.zeros(len(self.languages))
        for found, table in ((known, self.logs), (unseen, self.scored)):
            if found:
                rows, numbers = zip(*found)
                total += np.array(numbers, float) @ table.take(rows, axis=0)
        odds = np.exp((total - total.max()) / TEMPERATURE)
        best = int(total.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _counted(batches: Iterator[pa.RecordBatch], units: Callable[[list], Iterator[tuple[str, str, int]]]) -> Iterator[pa.RecordBatch]:
    """Sums per language and unit of what ``units`` gives for the columns of each batch, passed on before they grow too many."""
    held: Counter[tuple[str, str]] = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array(list(held.values()), pa.int64())], names=["lang", "unit", "n"])
        held.clear()
        return batch

    for batch in batches:
        for language, unit, n in units([c.to_pylist() for c in batch.columns]):
            held[language, unit] += n
            if len(held) > REMEMBERED:
                yield out()
    if held:
        yield out()


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, word, n)`` over whole texts; tasks add up before they shuffle."""
    def units(columns: list) -> Iterator[tuple[str, str, int]]:
        for language, value in zip(*columns):
            for word, n in Counter(words_of(value)).items():
                yield language, word, n

    rows = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
    counted = rows.mapInArrow(lambda batches: _counted(batches, units), "lang string, unit string, n bigint")
    return counted.groupBy("lang", F.col("unit").alias("word")).agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` of counted words."""
    def units(columns: list) -> Iterator[tuple[str, str, int]]:
        for language, word, n in zip(*columns):
            for gram in _grams(word):
                yield language, gram, n

    counted = words.select("lang", "word", "n").mapInArrow(lambda batches: _counted(batches, units), "lang string, unit string, n bigint")
    return counted.groupBy("lang", F.col("unit").alias("gram")).agg(F.sum("n").alias("n"))


def least_share(greatest: DataFrame, least: float, room: int) -> float:
    """``least``, or the first of its multiples by powers of sqrt(2) that ``room`` of the ``greatest`` shares at most reach."""
    steps = [least * 2 ** (i / 2) for i in range(2 * max(1, math.ceil(-math.log2(least))) + 1)]
    counts = greatest.agg(*[F.count(F.when(F.col("share") >= s, 1)).alias(f"n{i}") for i, s in enumerate(steps)]).first()
    return next((s for s, n in zip(steps, counts) if n <= room), 2.0)


def _shares(counts: DataFrame, unit: str, least: float, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Known units with a row of their shares in each language."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    greatest = staged(shares.groupBy(unit).agg(F.max("share").alias("share")).where(F.col("share") >= least), "greatest")
    least = least_share(greatest, least, min(UNITS, CELLS // max(1, len(languages))))
    known = greatest.where(F.col("share") >= least).select(unit)
    found = shares.join(known, unit, "left_semi").select(F.col(unit), "lang", "share").toArrow()
    units = found.column(0).combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    table = np.zeros((len(units.dictionary), len(languages)))
    table[units.indices.to_numpy(), pc.index_in(found.column(1), pa.array(languages, pa.string())).to_numpy()] = found.column(2).to_numpy()
    return units.dictionary.to_pylist(), table


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """From all rows of ``docs`` that have a language and a text."""
    counts = staged(word_counts(docs, lang, text), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    words, by_word = _shares(counts, "word", WORD_SHARE, languages)
    grams, by_gram = _shares(staged(gram_counts(counts), "grams"), "gram", NGRAM_SHARE, languages)
    logs = np.log(np.concatenate([by_word, by_gram, np.zeros((1, len(languages)))]) + FLOOR)
    return Model(languages, {w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(grams)}, logs)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(v.as_py()) for v in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)), run,
                       "doc_id bigint, lang_pred string, score double")


def classify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """The registered query: learned from all folds but one, applied to all rows."""
    out = held_out(F.col("doc_id"), folds, fold)
    model = learn(docs.where(~out & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
