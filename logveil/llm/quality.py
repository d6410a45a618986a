"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes ``FEATURES``, transformed so that they are roughly normal.  Per
class Spark sums counts, values and products of values over all labelled rows;
means and covariances follow from these sums.  A covariance is shrunk towards
the pooled one and towards its own diagonal, and factored once.  The score is
the logistic of the difference of the log densities plus the log prior odds,
divided by ``TEMPERATURE``, as the statistics are not independent.

Null and empty texts have the statistics of an empty text and a score like any
other.  Without labels of one class every score is the smoothed share of the
other.  Rows of ``labels`` with a null label, and labelled documents without an
id, teach nothing; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import held_out, map_batches, unused
from logveil.sources.staging import staged

#: The part of a class covariance taken from the pooled one, then from its own diagonal.
POOLED, DIAGONAL = 0.1, 0.1
#: Variance added to each statistic, so that a constant one does no harm.
FLOOR = 1e-3
TEMPERATURE = 4.0
#: A document is kept from this score on.
THRESHOLD = 0.3

_UPPER = bytes(range(0x41, 0x5B))

#: Added to the words that a share is taken of (characters: ``SPELL`` times as many), so that a few words tell little.
PRIOR, SPELL = 20, 6

FEATURES = ("word", "upper", "digit", "symbol", "shout", "bar", "repeat", "adjacent", "top", "line", "stop", "distinct", "phrases")


def features(text: str | None) -> list[float]:
    """The statistics named in ``FEATURES``, in that order: logarithms of means, square roots of smoothed shares."""
    raw = (text or "").encode()
    words = raw.split()
    n, counts = len(words), Counter(words)
    phrases = list(zip(words, words[1:], words[2:]))
    lines = [x for x in (line.strip() for line in raw.split(b"\n")) if x]
    per_char = PRIOR * SPELL + len(raw)
    chars = lambda k: math.sqrt(k / per_char)
    per_word = lambda k: math.sqrt(min(k, n) / (PRIOR + n))
    return [
        math.log((PRIOR * SPELL + len(raw)) / (PRIOR + n)),
        chars(len(raw) - len(raw.translate(None, _UPPER))),
        chars(len(raw) - len(raw.translate(None, b"0123456789"))),
        chars(len(raw) - len(raw.translate(None, b"#*$%&<>{}[]\\^~=+_@/"))),
        per_word(raw.count(b"!")),
        per_word(raw.count(b"|") + raw.count(b"\t")),
        math.sqrt((len(lines) - len(set(lines))) / (PRIOR / 2 + len(lines))),
        per_word(sum(map(eq, words, words[1:]))),
        per_word(max(counts.values(), default=1) - 1),
        math.log((PRIOR + n) / (1 + len(lines))),
        per_word(raw.count(b".")),
        per_word(n - len(counts)),
        per_word(len(phrases) - len(set(phrases))),
    ]


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of both classes; ``odds`` are the log prior odds of class 1."""

    odds: float
    means: list[np.ndarray]
    factors: list[np.ndarray]
    determinants: list[float]

    @classmethod
    def fit(cls, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """From count, sum and sum of products of each class."""
        n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
        odds = math.log((n[1] + 1) / (n[0] + 1))
        if not all(n):
            return cls(odds, [], [], [])
        means = [sums[c][1] / n[c] for c in (0, 1)]
        covs = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        shared = sum(k * cov for k, cov in zip(n, covs)) / sum(n)
        factors, determinants = [], []
        for cov in covs:
            cov = (1 - pooled) * cov + pooled * shared
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
            factors.append(np.linalg.cholesky(cov))
            determinants.append(2 * float(np.log(np.diag(factors[-1])).sum()))
        return cls(odds, means, factors, determinants)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Log density difference of the classes for each row, with the prior."""
        if not self.means or not len(rows):
            return np.full(len(rows), self.odds)
        density = []
        for mean, factor, determinant in zip(self.means, self.factors, self.determinants):
            scaled = np.linalg.solve(factor, (rows - mean).T)
            density.append(-0.5 * ((scaled**2).sum(axis=0) + determinant))
        return density[1] - density[0] + self.odds

    def scores(self, rows: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
        scale = temperature if self.means else 1.0
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows) / scale, -500, 500)))


def measured(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """``docs`` with the statistics of each text in place of the text."""
    columns = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(v.as_py()) for v in batch.column(len(columns))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*columns, name])

    return map_batches(docs.select(*columns, text), run, f"{schema}, `{name}` array<double>")


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0) -> Discriminant:
    """From all labelled ``rows`` ``(doc_id, features)`` but those of the fold that is held out.

    What reaches the driver is a few hundred sums.
    """
    wide = len(FEATURES)
    cells = [(i, j) for i in range(wide) for j in range(i + 1)]
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)) \
        .select("doc_id", F.col(label).cast("int").alias("label"))
    x = F.col("features")
    total = rows.select("doc_id", "features").join(known, "doc_id").groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(x[i]) for i in range(wide)]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in cells]).alias("p"))
    sums = {}
    for r in total.collect():
        products = np.zeros((wide, wide))
        for (i, j), v in zip(cells, r["p"]):
            products[i, j] = products[j, i] = v
        sums[r["label"]] = (r["n"], np.array(r["s"]), products)
    return Discriminant.fit(sums)


def scored(rows: DataFrame, model: Discriminant, name: str = "features", score: str = "score") -> DataFrame:
    """``rows`` with the score of their statistics."""
    at = rows.columns.index(name)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], names=[*batch.schema.names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, run, f"{schema}, `{score}` double")


def scored_texts(docs: DataFrame, model: Discriminant, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each text, by one Python worker for each task instead of one that measures and one that scores."""
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(v.as_py()) for v in batch.column(at)])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], names=[*batch.schema.names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{schema}, `{score}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; the texts are read once."""
    rows = staged(measured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), "statistics")
    return scored(rows, fit(rows, labels)).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they are."""
    score = unused(docs, "_score")
    model = fit(measured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))), labels)
    return scored_texts(docs, model, text, score).where(F.col(score) >= threshold).select(*docs.columns)
