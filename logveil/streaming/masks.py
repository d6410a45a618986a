"""Stateless masking and running counts, as plain streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions.rules import Catalogue
from logveil.operators.detect import mask
from logveil.operators.redact import redact_documents


def mask_stream(lines: DataFrame, line_col: str, catalogue: Catalogue | None = None) -> DataFrame:
    """Lines with the masking rules applied; append mode, no state, no pseudonyms."""
    return mask(lines, line_col, catalogue or Catalogue.builtin())


def hits_of(lines: DataFrame, line_col: str, catalogue: Catalogue | None = None) -> DataFrame:
    """The matches of the full cascade on each line, one row per match."""
    return redact_documents(lines, line_col, catalogue).withColumn("hit", F.explode("hits")).drop("hits", line_col) \
        .select("*", "hit.category").drop("hit")


def running_counts(lines: DataFrame, line_col: str, catalogue: Catalogue | None = None) -> DataFrame:
    """``(category, n)`` so far; update or complete mode."""
    return hits_of(lines, line_col, catalogue).groupBy("category").agg(F.count("*").alias("n"))


def windowed_counts(lines: DataFrame, line_col: str, time_col: str, width: str, lateness: str,
                    catalogue: Catalogue | None = None) -> DataFrame:
    """``(start, end, category, n)`` per window of event time."""
    counts = hits_of(lines.withWatermark(time_col, lateness), line_col, catalogue) \
        .groupBy(F.window(time_col, width).alias("w"), "category").agg(F.count("*").alias("n"))
    return counts.select("w.start", "w.end", "category", "n")
