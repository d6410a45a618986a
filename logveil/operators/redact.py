"""Redaction: ordered rewrite of text, with pseudonyms consistent per document or corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue
from logveil.operators import cascade
from logveil.operators.blocks import collapse_blocks
from logveil.operators.pseudonyms import CORPUS, DOC, Lookup, everything, given_before, number_across_rows, number_within_row, readable
from logveil.sources.staging import staged


def redact_documents(df: DataFrame, text_col: str, catalogue: Catalogue | None = None) -> DataFrame:
    """Redact rows that hold whole documents, pseudonyms numbered per row.

    Returns the rows with ``text_col`` rewritten and a column ``hits`` of
    ``(line_no, rule, category, pos, original)``.  One narrow pass: no shuffle.
    """
    catalogue = catalogue or Catalogue.builtin()
    df = cascade.start(df, text_col, catalogue)
    for rules in catalogue.stages():
        df = number_within_row(cascade.run_stage(df, rules, catalogue), rules, catalogue.spread_categories)
    return cascade.finish(df.drop("_given"), text_col)


@dataclass
class Redaction:
    """What a redaction gives: the rewritten rows, and the dictionary behind them.

    ``rows`` has the input's columns and ``hits``; ``dictionary`` is
    ``(scope, category, original, id, replacement)``.
    """

    rows: DataFrame
    dictionary: DataFrame
    entries: DataFrame


def across(df: DataFrame, rules_by_stage, catalogue, unit, scope, line_no, known) -> tuple[DataFrame, DataFrame]:
    """Run the stages over rows whose scope spans rows; one staged table per barrier."""
    dictionaries = []
    for rules in rules_by_stage:
        df = cascade.run_stage(df, rules, catalogue)
        if any(r.is_unique for r in rules):
            before = known
            if dictionaries and any(r.category in catalogue.spread_categories for r in rules if r.is_unique):
                before = given_before(reduce(DataFrame.unionByName, [everything(known), *dictionaries] if known is not None else dictionaries), rules)
            df, found = number_across_rows(df, rules, unit, scope, line_no, before)
            dictionaries.append(found)
    if not dictionaries:
        return df, None
    return df, reduce(DataFrame.unionByName, dictionaries)


def across_narrow(base: DataFrame, catalogue: Catalogue, keys: list[str], scope: str, line_no: str,
                  known: DataFrame | Lookup | None) -> tuple[DataFrame, DataFrame | None]:
    """``across`` for started rows, moving no more of them than a barrier needs; they carry ``_scope``.

    The rows are staged once.  Only those with a candidate line pass the barriers,
    and only with these lines, their gates and hits; everything else, the text
    around them too, waits in the staged table and is joined back once, by row.
    """
    base = staged(base.withColumn("_row", F.monotonically_increasing_id()), "base")
    narrow = base.filter("_text != ''").select("_row", "_scope", *keys, "_text", "_mask", "_hits")
    done, entries = across(narrow, catalogue.stages(), catalogue, ["_row"], scope, line_no, known)
    done = done.select("_row", F.col("_text").alias("_new_text"), F.col("_hits").alias("_new_hits"))
    rows = base.join(done, "_row", "left").withColumns({
        "_text": F.coalesce("_new_text", "_text"), "_hits": F.coalesce("_new_hits", "_hits")})
    return rows.drop("_row", "_new_text", "_new_hits"), entries


def redact_corpus(df: DataFrame, id_col: str, text_col: str, catalogue: Catalogue | None = None,
                  known: DataFrame | None = None) -> Redaction:
    """Redact rows that hold whole documents, one value having one pseudonym in all of them.

    Documents without any candidate line take no part in a barrier.  Rows are told
    apart by themselves, so values of ``id_col`` may repeat or be missing.  ``known``
    is the ``entries`` of an earlier run whose numbers are to be kept.
    """
    catalogue = catalogue or Catalogue.builtin()
    base = cascade.start(df, text_col, catalogue).withColumn("_scope", F.lit(CORPUS))
    rows, entries = across_narrow(base, catalogue, [], CORPUS, "0", known)
    rows = cascade.finish(rows, text_col).drop("_scope")
    return Redaction(rows, None if entries is None else readable(entries, everything(known)), entries)


def redact_lines(df: DataFrame, doc_col: str, line_no_col: str, line_col: str, scope: str = DOC,
                 catalogue: Catalogue | None = None, known: DataFrame | None = None,
                 blocks: bool = True) -> Redaction:
    """Redact a log kept as lines, of any length, pseudonyms numbered per document or corpus.

    Only lines that a rule may change go through the cascade; the others are
    passed on as they are.  ``blocks=False`` skips the rules that span lines.
    """
    catalogue = catalogue or Catalogue.builtin()
    if blocks:
        df = collapse_blocks(df, doc_col, line_no_col, line_col, catalogue)
    else:
        df = df.withColumn("hits", F.expr("cast(array() AS array<struct<line_no:bigint,rule:int,"
                                          "category:string,pos:int,original:string>>)"))
    df = df.withColumnRenamed("hits", "_block_hits")
    candidate = f"coalesce({T.matches(line_col, T.candidate_regex(catalogue))} OR " \
                f"{T.any_contains(line_col, T.WORKING_CHARACTERS)}, false)"
    idle = df.filter(f"NOT {candidate}").withColumnRenamed("_block_hits", "hits")
    base = cascade.start_lines(df.filter(candidate), line_col, line_no_col, catalogue) \
        .withColumn("_scope", F.coalesce(F.col(doc_col).cast("string"), F.lit("")) if scope == DOC else F.lit(CORPUS))
    busy, entries = across(base, catalogue.stages(), catalogue, [doc_col, line_no_col], scope, line_no_col, known)
    done = cascade.finish(busy, line_col).drop("_scope") \
        .withColumn("hits", F.concat("_block_hits", "hits")).drop("_block_hits")
    return Redaction(done.unionByName(idle), None if entries is None else readable(entries, everything(known)), entries)


def findings(rows: DataFrame, *id_cols: str) -> DataFrame:
    """One row per match: ``(*id_cols, line_no, rule, category, pos, original)``."""
    return rows.select(*id_cols, F.inline("hits"))


def counts_map(hits: str = "hits") -> str:
    """Matches per category of one row, as a map without zeros."""
    return T.let(
        "names", f"transform({hits}, h -> h.category)",
        "map_from_entries(transform(array_sort(array_distinct(names)), "
        "c -> named_struct('category', c, 'n', cast(size(filter(names, x -> x = c)) AS bigint))))")
