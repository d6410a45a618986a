"""The registered queries of this subpackage, and the same results as SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logveil.llm import alignment, copies, decontaminate, html, language, lines, neardup, packing, quality, rules, search, surrogates, tokencount
from logveil.llm.common import table

#: Key of the registered query; a job that is to keep a secret passes its own.
KEY = "registered"

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = decontaminate.build(table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), automaton))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(rules.ledger(table(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(neardup.near_duplicates(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.digest(surrogates.pseudonymise(table(spark, sf_dir, "documents"), KEY))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents")))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.exact_copies(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_quality": op2_quality,
        "op3_line_dedup": op3_line_dedup,
        "op4_rules": op4_rules,
        "op5_language": op5_language,
        "op6_main_text": op6_main_text,
        "op7_token_counts": op7_token_counts,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_packing": op9_packing,
        "op10_surrogates": op10_surrogates,
        "op11_alignment": op11_alignment,
        "op12_exact_copies": op12_exact_copies,
        "op13_search": op13_search,
    }


def statements() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op3_line_dedup": lines.ORACLE,
        "op4_rules": rules.ORACLE,
        "op12_exact_copies": copies.ORACLE,
        "op13_search": search.ORACLE,
    }
