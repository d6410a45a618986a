"""Dictionaries of pseudonyms: dense numbers for distinct values, and their use in text.

Two ways give the same text.  ``number_within_row`` serves rows that hold a
whole scope (a document) and never shuffles.  ``number_across_rows`` serves a
scope spread over many rows (a huge log kept as lines, or a whole corpus): it
shuffles keys only, plus the rows that hold any, and bounds every task whatever
the skew.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue, Rule
from logveil.operators import cascade
from logveil.sources.staging import staged

DOC, CORPUS = "doc", "corpus"
LINES_PER_BUCKET = 65536
#: Entries that are looked up one by one, without buckets.
FEW = 4
HEAVY_SHARE = 1000
HEAVY_COUNT = 10_000
HEAVY_LENGTH = 65536


@runtime_checkable
class Lookup(Protocol):
    """Entries of earlier runs that are too many to read: those of some keys, and the greatest numbers of all."""

    last: DataFrame

    def among(self, keys: DataFrame) -> DataFrame: ...

    def all(self) -> DataFrame: ...


def everything(known: DataFrame | Lookup | None) -> DataFrame | None:
    return known.all() if isinstance(known, Lookup) else known


def unique_categories(rules: list[Rule]) -> list[str]:
    return sorted({r.category for r in rules if r.is_unique})


# --- looking numbers up inside a row -----------------------------------------

def _hashed(entries: str) -> str:
    """``(key, number)`` entries spread over about sqrt(n) hash buckets.

    Built-in array and map lookups are linear; this keeps a row with many
    distinct values from costing the square of their number.
    """
    few = f"IF(size(entries) <= {FEW}, array(entries), {{}})"
    spread = T.let("width", "greatest(1, cast(ceil(sqrt(size(entries))) AS int))",
                   "transform(sequence(0, width - 1), b -> "
                   "filter(entries, e -> pmod(hash(e.key), width) = b))")
    return T.let("entries", entries, few.format(spread))


def _resolve(text: str, numbers: str = "_numbers") -> str:
    """The text with its symbols replaced by the numbers looked up."""
    def number(body: str) -> str:
        bucket = f"get({numbers}, pmod(hash({body}), size({numbers})))"
        return f"get(filter({bucket}, e -> e.key = {body}), 0).number"
    single = f"replace({text}, {T.symbol('bodies[0]')}, coalesce({number('bodies[0]')}, ''))"
    several = T.numbered(text, f"transform(bodies, body -> {number('body')})")
    return T.when(T.has_symbols(text), T.let("bodies", T.symbols(text), T.when("size(bodies) = 1", single, several)), text)


def _settle(df: DataFrame) -> DataFrame:
    """Put the numbers of ``_numbers`` into the text and the hits."""
    settled = ("transform(_hits, h -> named_struct('place', h.place, 'rule', h.rule, "
               f"'category', h.category, 'pos', h.pos, 'original', {_resolve('h.original')}))")
    return df.withColumns({
        "_text": F.expr(_resolve("_text")),
        "_hits": F.expr(T.when(f"_numbers IS NOT NULL AND exists(_hits, h -> {T.has_symbols('h.original')})", settled, "_hits"))}).drop("_numbers")


def _written(body: str) -> str:
    """The body of a symbol with the symbols inside its value replaced by their numbers."""
    value = f"decode(unhex(substring_index({body}, '=', -1)), 'UTF-8')"
    return T.let("inner", value, T.when(T.has_symbols("inner"), T.symbol_body(f"substring_index({body}, '=', 1)", _resolve("inner")), body))


def number_within_row(df: DataFrame, rules: list[Rule], spread: set[str] = frozenset()) -> DataFrame:
    """Settle the symbols of a stage: first seen in the row, first numbered.

    Values of the categories in ``spread`` are kept in ``_given`` for the stages
    that follow, where they keep their numbers and new ones come after them.
    """
    categories = unique_categories(rules)
    if not categories:
        return df
    shared = [c for c in categories if c in spread]
    if shared and "_given" not in df.columns:
        df = df.withColumn("_given", F.expr("cast(array() AS array<struct<key:string,number:string>>)"))
    found = []
    for c in categories:
        of = f"startswith(k, {T.literal(c + '=')})"
        if c in spread:
            given = f"filter(_given, g -> startswith(g.key, {T.literal(c + '=')}))"
            found.append(f"transform(filter(keys, k -> {of} AND NOT exists(_given, g -> g.key = k)), (k, i) -> named_struct("
                         f"'key', k, 'number', {T.number_text(T.literal(c), f'(size({given}) + i + 1)', [c])}))")
        else:
            found.append(f"transform(filter(keys, k -> {of}), (k, i) -> "
                         f"named_struct('key', k, 'number', {T.number_text(T.literal(c), '(i + 1)', [c])}))")
    entries = T.let("keys", cascade.symbolic_keys("_hits", rules), f"concat({', '.join([*found, *['_given'] * bool(shared)])})")
    if not shared:
        return _settle(cascade.barrier(df, _numbers=T.when(T.has_symbols("_text"), _hashed(entries))))
    df = cascade.barrier(df, _fresh=T.when(T.has_symbols("_text"), entries))
    df = cascade.barrier(df, _numbers=T.when("_fresh IS NOT NULL", _hashed("_fresh")))
    kept = " OR ".join(f"startswith(e.key, {T.literal(c + '=')})" for c in sorted(spread))
    df = cascade.barrier(df, _given=T.when("_fresh IS NOT NULL", (
        f"transform(filter(_fresh, e -> {kept}), e -> named_struct('key', {_written('e.key')}, 'number', e.number))"), "_given"))
    return _settle(df.drop("_fresh"))


# --- dense numbers across rows -----------------------------------------------

def dense_numbers(values: DataFrame, groups: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group 1, 2, 3, … in the order (bucket, *order).

    ``bucket`` must rise with the order.  Only a bucket, never a whole group, is
    sorted in one task; the buckets' sizes give each its first number.
    """
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy(*groups, bucket).count() \
        .select(*groups, bucket, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, bucket).orderBy(*order)
    return values.join(offsets, [*groups, bucket]) \
        .withColumn(name, F.col("_offset") + F.row_number().over(within)).drop("_offset")


def build_dictionary(keys: DataFrame, scope: str, categories: list[str], known: DataFrame | None = None,
                     last: DataFrame | None = None) -> DataFrame:
    """Number the distinct values of ``keys(_scope, body, _line, _first)``.

    In document scope numbers follow first appearance.  In corpus scope, where
    documents have no order, they follow the digest of the value, which neither
    partitioning nor arrival can change.  ``known`` values keep their numbers and
    new ones are numbered after them, or after ``last`` where ``known`` are not all.
    """
    values = keys.groupBy("_scope", "body").agg(
        F.min(F.struct("_line", "_first")).alias("_seen"), F.count("*").alias("n"))
    values = values.withColumn("category", F.expr("substring_index(body, '=', 1)")) \
        .withColumn("original", F.expr("decode(unhex(substring_index(body, '=', -1)), 'UTF-8')"))
    if known is not None:
        values = values.join(known.select("_scope", "body"), ["_scope", "body"], "left_anti")
    if scope == DOC:
        values = values.withColumn("_bucket", F.floor(F.col("_seen._line") / LINES_PER_BUCKET))
        order = ["_seen"]
    else:
        values = values.withColumn("_digest", F.md5("original")) \
            .withColumn("_bucket", F.substring("_digest", 1, 3))
        order = ["_digest", "original"]
    numbered = dense_numbers(values, ["_scope", "category"], "_bucket", order, "id")
    if known is not None:
        # One row per scope and category, so the join is small whenever scopes are few.
        last = known.groupBy("_scope", "category").agg(F.max("id").alias("_last")) if last is None else last.withColumnRenamed("last", "_last")
        numbered = numbered.join(last, ["_scope", "category"], "left") \
            .withColumn("id", F.col("id") + F.coalesce("_last", F.lit(0)))
    return numbered.select(
        "_scope", "category", "body", "original", "id", "n",
        F.expr(T.pseudonym("category", "id", categories)).alias("replacement"),
        F.expr(T.number_text("category", "id", categories)).alias("number"))


def _look_up(keys: DataFrame, dictionary: DataFrame, unit: list[str]) -> DataFrame:
    """Per unit, its keys with their numbers.

    A value that holds more than 1/HEAVY_SHARE of all keys would overload the
    task its hash falls on.  There can be at most HEAVY_SHARE such values, so those
    of limited length are broadcast; all others are joined by a shuffle.
    """
    entry = dictionary.select("_scope", "body", "number", "n")
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    limit = max(total / HEAVY_SHARE, HEAVY_COUNT)
    is_heavy = (F.col("n") > limit) & (F.length("body") <= HEAVY_LENGTH)
    light = entry.filter(~is_heavy).drop("n")
    if total > limit:
        heavy = F.broadcast(entry.filter(is_heavy).drop("n"))
        found = keys.join(heavy, ["_scope", "body"]).unionByName(
            keys.join(heavy, ["_scope", "body"], "left_anti").join(light, ["_scope", "body"]))
    else:
        found = keys.join(light, ["_scope", "body"])
    return found.groupBy(*unit).agg(
        F.collect_list(F.struct(F.col("body").alias("key"), "number")).alias("_entries"))


def number_across_rows(df: DataFrame, rules: list[Rule], unit: list[str], scope: str, line_no: str,
                       known: DataFrame | Lookup | None = None) -> tuple[DataFrame, DataFrame]:
    """Settle the symbols of a stage over many rows; returns the rows and the dictionary.

    ``unit`` names the columns that identify a row and ``_scope`` is its scope.  The
    rows are staged, as they are read several times: for their keys alone, without
    the text, and then once as a whole.
    """
    categories = unique_categories(rules)
    df = staged(df.withColumn("_keys", F.expr(cascade.symbolic_keys("_hits", rules))), "stage")
    hot, cold = df.filter("size(_keys) > 0").drop("_keys"), df.filter("size(_keys) = 0").drop("_keys")
    keys = df.select("_scope", *unit, F.expr(f"coalesce(cast({line_no} AS bigint), 0)").alias("_line"),
                     F.posexplode("_keys").alias("_first", "body"))
    last = None
    if isinstance(known, Lookup):
        known, last = staged(known.among(keys), "known"), known.last
    fresh = build_dictionary(keys, scope, categories, known, last)
    dictionary = staged(fresh, "dictionary")
    entries = dictionary
    if known is not None:
        recent = keys.groupBy("_scope", "body").agg(F.count("*").alias("n"))
        used = known.drop("n").join(recent, ["_scope", "body"])
        entries = staged(dictionary.unionByName(used.select(dictionary.columns)), "entries")
    # The dictionary of a key inside a key: the row that holds both also holds both keys.
    numbers = _look_up(keys.drop("_line", "_first"), entries, unit) \
        .select(*[F.col(u).alias(f"_unit_{u}") for u in unit], F.expr(_hashed("_entries")).alias("_numbers"))
    same = reduce(lambda a, b: a & b, (F.col(u).eqNullSafe(F.col(f"_unit_{u}")) for u in unit))
    settled = _settle(hot.join(numbers, same).drop(*[f"_unit_{u}" for u in unit]))
    return settled.unionByName(cold), dictionary


def written_out(dictionary: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The entries without values inside values, and the others with these written out; ``known`` gives numbers, too."""
    plain = dictionary.filter(~F.expr(T.has_symbols("original")))
    nested = dictionary.filter(F.expr(T.has_symbols("original")))
    inner = nested.select("_scope", F.col("body").alias("_outer"), F.explode(F.array_distinct(
        F.expr(T.symbols("original")))).alias("body"))
    numbers = dictionary.select("_scope", "body", "number")
    if known is not None:
        numbers = numbers.unionByName(known.select("_scope", "body", "number"))
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("no entry for "), "body")))
    numbers = inner.join(numbers, ["_scope", "body"], "left").groupBy("_scope", F.col("_outer").alias("body")) \
        .agg(F.collect_list(F.struct(F.col("body").alias("key"), number.alias("number"))).alias("_entries")) \
        .withColumn("_numbers", F.expr(_hashed("_entries")))
    written = nested.join(numbers, ["_scope", "body"]).withColumn("original", F.expr(_resolve("original")))
    return plain, written.select(plain.columns)


def given_before(known: DataFrame, rules: list[Rule]) -> DataFrame:
    """Entries of earlier stages as a stage with ``rules`` meets them: values inside values are numbers by now."""
    _, nested = written_out(known)
    nested = nested.withColumn("body", F.expr(T.symbol_body("category", "original"))).join(known, ["_scope", "body"], "left_anti")
    return known.unionByName(nested.select(known.columns)).filter(F.col("category").isin(unique_categories(rules)))


def readable(dictionary: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(scope, category, original, id, replacement)``, with values inside values written out."""
    plain, written = written_out(dictionary, known)
    return plain.unionByName(written).select(
        F.col("_scope").alias("scope"), "category", F.expr(T.unprotect("original")).alias("original"), "id", "replacement")
