"""Checks that a redaction kept what it must keep and left nothing it must not leave.

Each returns the offending rows, so that an empty result means "passed".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue, pseudonym_format
from logveil.operators.detect import detect_all


def expected_counts(expected: DataFrame, actual: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Categories whose ``n`` is off by more than the tolerance, missing ones included."""
    both = expected.select("category", F.col("n").alias("expected")).join(
        actual.select("category", F.col("n").alias("actual")), "category", "full_outer") \
        .na.fill(0, ["expected", "actual"])
    return both.withColumn("difference", F.col("actual") - F.col("expected")) \
        .filter(F.abs("difference") > tolerance * F.col("expected"))


def line_counts(rows: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """Documents that gained or lost lines, those aside that the blocks found in them held."""
    newlines = lambda c: f"cast(regexp_count({c}, '\\n') AS bigint)"
    blocks = (f"aggregate(filter(hits, h -> h.line_no IS NULL), 0L, (n, h) -> n + {newlines('h.original')})")
    return rows.select(id_col, F.expr(newlines(before)).alias("lines_before"), F.expr(newlines(after)).alias("lines_after"),
                       F.expr(blocks).alias("_in_blocks")) \
        .filter("lines_before != lines_after + _in_blocks").drop("_in_blocks")


def clean_lines(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Lines that changed without a hit on them; ``rows`` carry ``hits``."""
    return rows.filter(F.expr(f"NOT (`{before}` <=> `{after}`) AND size(hits) = 0"))


def indentation(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Empty lines that are no longer empty, and lines whose leading white space changed."""
    lead = lambda c: f"regexp_extract({c}, '^\\\\s*', 0)"
    return rows.filter(F.expr(f"({before} = '') != ({after} = '') OR {lead(before)} != {lead(after)}"))


def json_kept(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Lines that were JSON and no longer are."""
    return rows.filter(F.expr(
        f"ltrim({before}) LIKE '{{%' AND try_parse_json({before}) IS NOT NULL AND try_parse_json({after}) IS NULL"))


def bijection(dictionary: DataFrame) -> DataFrame:
    """Originals with several numbers, and numbers with several originals, per scope and category."""
    def violations(one: str, many: str, kind: str) -> DataFrame:
        return dictionary.groupBy("scope", "category", F.col(one).cast("string").alias("value")) \
            .agg(F.count_distinct(many).alias("n")).filter("n > 1").withColumn("kind", F.lit(kind))
    return violations("original", "id", "original").unionByName(violations("id", "original", "id"))


def allowed_shapes(catalogue: Catalogue) -> str:
    """What a rule may still match in redacted text: markers, pseudonyms and strings of them."""
    dotted = lambda t: t.replace(".", "[.]")
    formats = sorted({pseudonym_format(r.category) for r in catalogue if r.is_unique})
    numbers = [dotted(before) + "[0-9]+" + dotted(after) for before, _, after in formats]
    parts = "|".join(["[A-Z_]*REDACTED[A-Z_]*", *numbers, "@redacted[.]com", "[.]redacted"])
    return f"^(?:{parts})+$"


def residual(rows: DataFrame, id_cols: list[str], text_col: str, catalogue: Catalogue) -> DataFrame:
    """Values that the rules still find in redacted text, other than pseudonyms and markers."""
    found = detect_all(rows, id_cols, text_col, catalogue)
    return found.filter(~F.expr(T.matches("original", allowed_shapes(catalogue))))


_WORDS = r"[\\p{L}\\p{N}_]+"


def leaks(findings: DataFrame, lines: DataFrame, id_cols: list[str], line_col: str) -> DataFrame:
    """``(*id_cols, category, original)``: values that were found in the input and stand, as whole words, in redacted lines.

    ``findings`` has ``(category, original)``.  A line holds a value only if it has
    every word of it.  So each value is anchored at that of its words which fewest
    redacted lines have; values with a word that no line has need no look.  The
    lines with an anchor are joined to it, and tested for the whole value.  Values
    without a letter or digit are not looked for.
    """
    words = lines.select(*id_cols, line_col, F.explode(F.array_distinct(F.expr(f"regexp_extract_all({line_col}, '{_WORDS}', 0)"))).alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("lines"))
    values = findings.select("category", "original").distinct() \
        .withColumn("words", F.array_distinct(F.expr(f"regexp_extract_all(original, '{_WORDS}', 0)"))).filter("size(words) > 0")
    parts = values.select("category", "original", F.size("words").alias("n"), F.explode("words").alias("word")).join(known, "word")
    anchored = parts.groupBy("category", "original", "n").agg(
        F.count("*").alias("met"), F.min(F.struct("lines", "word")).alias("rarest")).filter("met = n") \
        .select("category", "original", F.col("rarest.word").alias("word"))
    met = words.join(anchored, "word").filter(F.expr(f"contains({line_col}, original)"))
    inside = "[\\\\p{L}\\\\p{N}_]"
    quoted = f"replace(original, {T.literal(chr(92) + 'E')}, {T.literal(chr(92) + 'E' + 2 * chr(92) + 'E' + chr(92) + 'Q')})"
    whole = (f"{line_col} RLIKE concat(IF(original RLIKE '^{inside}', '(?<!{inside})', ''), '\\\\Q', {quoted}, '\\\\E', "
             f"IF(original RLIKE '{inside}$', '(?!{inside})', ''))")
    return met.filter(F.expr(whole)).select(*id_cols, "category", "original").distinct()


def length_ratio(rows: DataFrame, id_col: str, before: str, after: str, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Documents that shrank or grew beyond reason."""
    return rows.select(id_col, F.length(before).cast("bigint").alias("chars_before"),
                       F.length(after).cast("bigint").alias("chars_after")) \
        .filter(f"chars_before > 0 AND (chars_after < {low} * chars_before OR chars_after > {high} * chars_before)")


def valid_utf8(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.filter(~F.expr(f"is_valid_utf8({text_col})")).select(id_col)


def complete(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.select(key).join(outputs.select(key), key, "left_anti")
