"""Quality rules as a ledger of failure bits and measurements.

``ledger`` evaluates every rule once per document and keeps what it measured
and one bit per failed rule.  A policy is a version with the rules it applies;
policies are applied, compared and taken apart on the ledger alone, by bitwise
functions, without reading a text again.  Only SQL functions are used.

Words are runs of anything but ASCII white space.  A null text counts as empty,
has no words and fails ``few_words``.  Rows are judged one by one, so repeated
rows get equal results, and other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a window that must not repeat.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_bars",
            "n_upper", "n_adjacent")

#: A rule's bit is its place here.  A document fails where the condition over the measurements holds.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "shouting": "5 * n_shouts > n_words AND 5 * n_upper > word_chars",
    "bars": "5 * n_bars > n_words",
    "repeated_words": "5 * n_adjacent > n_words",
    "repeated_lines": "n_lines >= 10 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
#: Versions of the policy, with their rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "bars", "repeated_words"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << bit for bit, name in enumerate(RULES) if name in rules)


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated() -> str:
    """Words that lie in a window found twice or more, over the words ``w``.

    Windows are compared by a 64-bit hash.  Only where some repeat they are
    sorted, which puts equal ones side by side; the places are then sorted and
    the words they cover are added up.
    """
    hashes = _let("h", "transform(w, x -> xxhash64(x))",
                  f"transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW})))")
    twice = "filter(transform(s, (x, i) -> if(x.h <=> get(s, i - 1).h OR x.h <=> get(s, i + 1).h, x.i, null)), x -> x IS NOT NULL)"
    covered = (f"aggregate(array_sort({twice}), named_struct('n', 0, 'to', -1), "
               f"(a, i) -> named_struct('n', a.n + {WINDOW} - greatest(0, a.to - i), 'to', i + {WINDOW}), a -> a.n)")
    places = _let("s", "sort_array(transform(g, (x, i) -> named_struct('h', x, 'i', i)))", covered)
    return f"if(size(w) < {WINDOW}, 0, {_let('g', hashes, f'if(size(array_distinct(g)) = size(g), 0, {places})')})"


def measurements(text: str) -> str:
    """A struct of ``MEASURES`` of a text."""
    joined = "translate(t, ' \\t\\n\\u000B\\u000C\\r', '')"
    lines = "filter(split(t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    values = {
        "n_words": "size(w)",
        "word_chars": f"char_length({joined})",
        "n_symbols": f"char_length(t) - char_length(translate(t, '{SYMBOLS}', ''))",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": _repeated(),
        "n_lines": "size(l)",
        "n_shouts": "char_length(t) - char_length(translate(t, '!', ''))",
        "n_bars": "char_length(t) - char_length(translate(t, '|', ''))",
        "n_upper": "char_length(t) - char_length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
        "n_adjacent": "size(filter(w, (x, i) -> x = get(w, i - 1)))",
    }
    struct = "named_struct(" + ", ".join(f"'{k}', cast({values[k]} AS bigint)" for k in MEASURES) + ")"
    words = "filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"
    return _let("t", f"coalesce({text}, '')", _let("w", words, _let("l", lines, struct)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``measures`` and ``failed``, the bits of the rules that each fails.

    Columns of ``docs`` with these names, or named ``kept``, are replaced.
    """
    m, columns = "measures", [c for c in docs.columns if c != text and c.lower() not in ("measures", "failed", "kept")]
    failed = " + ".join(f"if({_of(condition, m)}, {1 << bit}L, 0L)" for bit, condition in enumerate(RULES.values()))
    # a generator of one row keeps the optimizer from copying the measurements into every use of them
    measured = docs.select(*columns, F.explode(F.array(F.expr(measurements(f"`{text}`")))).alias(m))
    return measured.withColumn("failed", F.expr(failed))


def _of(condition: str, struct: str) -> str:
    for name in MEASURES:
        condition = condition.replace(name, f"{struct}.{name}")
    return condition


def failed_any(failed: Column, rules: tuple[str, ...]) -> Column:
    return failed.bitwiseAND(F.lit(mask(rules))) != 0


def policies(spark: SparkSession, versions: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``(version, mask)``"""
    return spark.createDataFrame([(v, mask(r)) for v, r in versions.items()], "version string, mask bigint")


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a version."""
    return entries.withColumn("kept", ~failed_any(F.col("failed"), POLICIES[version]))


def ablations(entries: DataFrame, versions: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``(version, rule, n_failed, n_alone, n_kept)``: documents that fail a rule, that fail no other rule of the
    version, and that the version without the rule keeps.

    The ledger is aggregated to one row for each set of bits, of which there are at most 2 to the number of rules.
    """
    spark = entries.sparkSession
    sets = entries.groupBy("failed").count()
    rules = spark.createDataFrame([(name, 1 << bit) for bit, name in enumerate(RULES)], "rule string, bit bigint")
    rows = policies(spark, versions).join(rules, F.col("mask").bitwiseAND(F.col("bit")) != 0)
    both = sets.crossJoin(F.broadcast(rows)).withColumn("own", F.col("failed").bitwiseAND(F.col("mask")))
    rest = F.col("own").bitwiseAND(F.bitwise_not("bit"))
    total = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    return both.groupBy("version", "rule").agg(
        total(F.col("own").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("own") == F.col("bit")).alias("n_alone"),
        total(rest == 0).alias("n_kept"))


def digest(entries: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    judged = apply_policy(entries)
    return judged.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[f"measures.{m}" for m in MEASURES[:5]],
                         failed_any(F.col("failed"), POLICIES["base"]).alias("base_failed"), "failed", "kept")


_CONDITIONS = " + ".join(f"CASE WHEN {condition} THEN {1 << bit} ELSE 0 END" for bit, condition in enumerate(RULES.values()))
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
places AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS x FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM places) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts, length(t) - length(replace(t, '|', '')) AS n_bars,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adjacent
  FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, cast({_CONDITIONS} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask(POLICIES['base'])} <> 0 AS base_failed,
       failed, failed & {mask(POLICIES[CURRENT])} = 0 AS kept FROM f"""
