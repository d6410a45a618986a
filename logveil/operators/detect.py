"""One rule by itself: where it matches, how often, and what its mask leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue, Rule


def _gated(text: str, rule: Rule) -> str:
    return T.gate(f"lower({text})", rule)


def detect(df: DataFrame, id_cols: list[str], text_col: str, rule: Rule, catalogue: Catalogue) -> DataFrame:
    """``(*id_cols, rule, category, pos, original)`` of one rule on raw text, under its gate."""
    return df.filter(F.expr(_gated(text_col, rule))).select(
        *id_cols, F.lit(rule.rule_id).alias("rule"), F.lit(rule.category).alias("category"),
        F.posexplode(F.expr(T.match_values(text_col, rule, catalogue.regex(rule)))).alias("pos", "original")) \
        .withColumn("pos", (F.col("pos") + 1).cast("bigint"))


def detect_all(df: DataFrame, id_cols: list[str], text_col: str, catalogue: Catalogue) -> DataFrame:
    """Findings of every rule on raw text, in one pass over it."""
    per_rule = ", ".join(
        T.when(T.gate("low", r),
               f"transform({T.match_values(text_col, r, catalogue.regex(r))}, (v, i) -> named_struct("
               f"'rule', {r.rule_id}, 'category', {T.literal(r.category)}, 'pos', cast(i + 1 AS bigint), 'original', v))")
        for r in catalogue)
    found = T.let("low", f"lower({text_col})", f"flatten(array_compact(array({per_rule})))")
    return df.select(*id_cols, F.explode(F.expr(found)).alias("hit")).select(*id_cols, "hit.*")


def count(df: DataFrame, text_col: str, rule: Rule, catalogue: Catalogue) -> DataFrame:
    """``(rule, category, n)``: matches of one rule in the whole table."""
    n = F.sum(F.expr(T.match_count(text_col, catalogue.regex(rule))).cast("bigint"))
    return df.filter(F.expr(_gated(text_col, rule))).agg(F.coalesce(n, F.lit(0)).alias("n")) \
        .select(F.lit(rule.rule_id).alias("rule"), F.lit(rule.category).alias("category"), "n")


def mask(df: DataFrame, text_col: str, catalogue: Catalogue, into: str | None = None) -> DataFrame:
    """Apply the masking line rules in order, without state: for streams, or where no pseudonyms are wanted.

    Gates are taken once, from the raw line, as in the full cascade.
    """
    rules = [r for r in catalogue.line_rules if not r.is_unique]
    into = into or text_col
    df = df.withColumn("_bits", F.expr(T.let("low", f"lower({text_col})", T.gate_mask("low", rules))))
    text = reduce(
        lambda acc, ir: T.let("t", acc, T.when(
            f"(_bits & {1 << ir[0]}L) != 0", T.masked("t", ir[1], catalogue.regex(ir[1])), "t")),
        enumerate(rules), text_col)
    return df.withColumn(into, F.expr(T.when("_bits != 0", text, text_col))).drop("_bits")
