"""Rules that span lines, for logs kept as one row per line.

A document held in one row gets these rules as regular expressions over its
text.  A log too large for that is read as lines, and a block (a PEM body, an SQL
statement with its continuation lines) becomes an island of rows.  Islands are
found by looking back over buckets of lines, so that no task ever holds a
whole log.

Two things differ from the regular expressions on purpose: white space inside an
SQL keyword pair does not cross a line end, and a line that closes one PEM block
and opens another stays a line of its own.  A hit on a block carries its first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue, Rule
from logveil.sources.staging import staged

LINES_PER_BUCKET = 65536
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
HITS = "array<struct<line_no:bigint,rule:int,category:string,pos:int,original:string>>"

# --- Fixed values: what opens, continues and closes a block -------------------
SQL_START = r"(?iu)^[ \t]*(?:SELECT|INSERT\s+INTO|UPDATE|DELETE(?:\s+FROM)?|WITH)\b"
SQL_CONTINUED = (
    r"(?iu)^(?:[ \t]+\S|[)]|(?:SELECT|FROM|WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|OFFSET|UNION|INTERSECT|EXCEPT"
    r"|AND|OR|SET|VALUES|INTO|CASE|WHEN|THEN|ELSE|END|JOIN|LEFT|RIGHT|INNER|OUTER|CROSS|FULL|NATURAL|ON|AS)\b)")
PEM_MARKERS = {
    "private_key": (r"-----BEGIN (?:RSA |DSA |EC )?PRIVATE KEY-----", r"-----END (?:RSA |DSA |EC )?PRIVATE KEY-----"),
    "certificate": (r"-----BEGIN CERTIFICATE-----", r"-----END CERTIFICATE-----"),
}
# --- End of fixed values -------------------------------------------------------


def latest(df: DataFrame, groups: list[str], bucket: str, order: list[str],
           upto: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """Add, per group, the latest value seen up to the current row, or before it.

    Values must rise with the order, so the latest is the greatest.  Each bucket
    is scanned by itself; rows that find nothing in their own bucket take the
    latest of the buckets before it, which are few.
    """
    upto, before = upto or {}, before or {}
    values = {**upto, **before}
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*groups, bucket).agg(*[F.max(v).alias(f"_max_{n}") for n, v in values.items()]) \
        .select(*groups, bucket, *[F.max(f"_max_{n}").over(earlier).alias(f"_carried_{n}") for n in values])
    within = Window.partitionBy(*groups, bucket).orderBy(*order)
    local = df.withColumns({
        **{n: F.max(v).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n, v in upto.items()},
        **{n: F.max(v).over(within.rowsBetween(Window.unboundedPreceding, -1)) for n, v in before.items()}})
    return local.join(carried, [*groups, bucket]).withColumns(
        {n: F.coalesce(n, f"_carried_{n}") for n in values}).drop(*[f"_carried_{n}" for n in values])


def _with_bucket(df: DataFrame, line_no: str) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(line_no) / LINES_PER_BUCKET))


def _hit(rule: Rule, line_no: str, pos: str, original: str) -> str:
    return (f"named_struct('line_no', cast({line_no} AS bigint), 'rule', {rule.rule_id}, "
            f"'category', {T.literal(rule.category)}, 'pos', {pos}, 'original', {original})")


def collapse_sql(df: DataFrame, doc: str, line_no: str, line: str, rule: Rule, gated: DataFrame) -> DataFrame:
    """Replace each SQL statement by one marker line, in the documents ``gated``.  ``df`` carries ``hits``.

    Only lines that can start or continue a statement are moved.
    """
    starts, continues = T.matches(line, SQL_START), T.matches(line, SQL_CONTINUED)
    df = df.withColumn("_start", F.expr(f"coalesce({starts}, false)")) \
        .withColumn("_cont", F.expr(f"coalesce({continues}, false)"))
    apart = df.filter("NOT _start AND NOT _cont").drop("_start", "_cont")
    # Staged, since looking back reads them several times and the way here may be long.
    lines = staged(_with_bucket(df.filter("_start OR _cont"), line_no), "candidates")

    lines = latest(lines, [doc], "_bucket", [line_no], before={"_previous": F.col(line_no)})
    broken = F.expr(f"NOT _cont OR _previous IS NULL OR _previous != {line_no} - 1")
    first = F.when(broken, F.col(line_no))
    begun = F.when(F.col("_start"), F.col(line_no))
    lines = latest(lines, [doc], "_bucket", [line_no],
                        upto={"_segment": first, "_begun": begun}, before={"_begun_before": begun})
    # The gate is a fact of the document; it is looked up once per bucket, so that a
    # huge document does not meet its single gate row in one task.
    passed = lines.select(doc, "_bucket").distinct() \
        .join(gated, F.col(doc) == F.col("_gated"), "left_semi").withColumn("_passed", F.lit(True))
    lines = lines.join(passed, [doc, "_bucket"], "left").withColumns({
        "_inside": F.expr("coalesce(_passed AND _begun >= _segment, false)"),
        "_opens": F.expr(f"_start AND (_segment = {line_no} OR _begun_before IS NULL OR _begun_before < _segment)")})
    kept = lines.filter("NOT _inside OR _opens").withColumns({
        "hits": F.expr(T.when("_inside", f"concat(hits, array({_hit(rule, line_no, '1', line)}))", "hits")),
        line: F.expr(T.when("_inside", T.literal(rule.replacement), line))})
    # Staged, since the caller reads the result more than once; the lines apart are cheap to read again.
    return staged(kept.select(*apart.columns), "statements").unionByName(apart)


def pem_blocks(marked: DataFrame, doc: str, line_no: str, line: str, begin: str, end: str) -> DataFrame:
    """``(doc, begin_line, end_line, tail)`` of the blocks that cross a line end, from the lines with markers.

    ``tail`` is what follows the end marker on its line and belongs on the line of
    the begin marker; it is missing where it begins a further block.
    """
    marker = f"{begin}|{end}"
    events = marked.select(
        doc, line_no, F.expr(T.substitute(line, f"^.*?{end}", "")).alias("_tail"),
        F.posexplode(F.expr(f"regexp_extract_all({line}, {T.literal(marker)}, 0)")).alias("_pos", "_mark"))
    events = _with_bucket(events, line_no).withColumn("_is_begin", F.col("_mark").startswith("-----BEGIN"))
    event = F.struct(line_no, "_pos", "_is_begin")
    order = [line_no, "_pos"]
    # A begin marker opens a block unless one is open; an end marker closes an open one.
    turns = latest(events, [doc], "_bucket", order, before={"_before": event}) \
        .filter(F.expr("IF(_is_begin, _before IS NULL OR NOT _before._is_begin, _before._is_begin)"))
    pairs = latest(turns, [doc], "_bucket", order, before={"_opened": F.struct(line_no, "_pos", "_is_begin")})
    return pairs.filter("NOT _is_begin").select(
        doc, F.col(f"_opened.{line_no}").alias("begin_line"), F.col(line_no).alias("end_line"),
        F.expr("IF(contains(_tail, '-----BEGIN '), NULL, _tail)").alias("tail")) \
        .filter("begin_line < end_line")


def collapse_pem(df: DataFrame, doc: str, line_no: str, line: str, rule: Rule) -> DataFrame:
    """Replace each PEM block by its marker.  ``df`` carries ``hits``."""
    begin, end = PEM_MARKERS[rule.category]
    regex = rule.regex()
    marked = staged(df.filter(F.expr(T.matches(line, f"{begin}|{end}"))).select(doc, line_no, line), "markers")
    if marked.isEmpty():
        return df
    blocks = staged(pem_blocks(marked, doc, line_no, line, begin, end), "blocks")
    spread = blocks.withColumn("_bucket", F.explode(F.expr(
        f"sequence(floor(begin_line / {LINES_PER_BUCKET}), floor(end_line / {LINES_PER_BUCKET}))")))
    size, tails = spread.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("tail")), F.lit(0))).first()
    if size == 0:
        lines = df.withColumns({"_end": F.lit(None).cast("bigint"), "_opens_at": F.lit(None).cast("bigint"),
                                "_tail": F.lit(None).cast("string"), "_end_tail": F.lit(None).cast("string")})
    else:
        # Blocks of one document do not overlap but at their ends, so a line lies in at
        # most one as an inner or last line and in at most one as a first line.
        inner = spread.select(F.col(doc).alias("_of"), F.col("_bucket").alias("_in"), F.col("begin_line").alias("_begin"),
                              F.col("end_line").alias("_end"), F.col("tail").alias("_end_tail"))
        opening = blocks.select(F.col(doc).alias("_of"), F.col("begin_line").alias("_opens_at"),
                                F.col("tail").alias("_tail"))
        if size <= BROADCAST_ROWS and tails <= BROADCAST_BYTES:
            inner, opening = F.broadcast(inner), F.broadcast(opening)
        lines = _with_bucket(df, line_no).join(inner, F.expr(
            f"{doc} = _of AND _bucket = _in AND {line_no} > _begin AND {line_no} <= _end"), "left").drop("_of")
        lines = lines.join(opening, F.expr(f"{doc} = _of AND {line_no} = _opens_at"), "left").drop("_of")
    # A last line stays only where its tail could not move to the first one.
    lines = lines.filter(f"_end IS NULL OR (_end = {line_no} AND _end_tail IS NULL)").withColumn(
        "_left", F.expr(T.when("_end IS NOT NULL", T.substitute(line, f"^.*?{end}", ""), line)))
    inline = f"transform({T.match_values('_left', rule, regex)}, (v, i) -> {_hit(rule, line_no, 'i + 1', 'v')})"
    opened = T.when("_opens_at IS NOT NULL",
                    f"array({_hit(rule, line_no, T.match_count('_left', regex) + ' + 1', line)})",
                    f"cast(array() AS {HITS})")
    masked = T.masked("_left", rule, regex)
    closed = T.substitute(masked, rf"{begin}.*$", T.quote_replacement(rule.replacement))
    marked = T.when("_opens_at IS NOT NULL", f"concat({closed}, coalesce(_tail, ''))", masked)
    touched = "(_end IS NOT NULL OR _opens_at IS NOT NULL OR contains(_left, '-----BEGIN '))"
    return lines.withColumns({
        "hits": F.expr(T.when(touched, f"concat(hits, {inline}, {opened})", "hits")),
        line: F.expr(T.when(touched, marked, line))}).select(*df.columns)


def collapse_blocks(df: DataFrame, doc: str, line_no: str, line: str, catalogue: Catalogue) -> DataFrame:
    """Apply the whole-text rules to a table of lines; adds the column ``hits``."""
    # Keys that are never missing, so that no join loses a row.
    df = df.withColumns({
        "_doc": F.expr(f"coalesce(concat('=', cast({doc} AS string)), '')"),
        "_no": F.expr(f"coalesce(cast({line_no} AS bigint), 0)"), "hits": F.expr(f"cast(array() AS {HITS})")})
    raw, doc, line_no = df, "_doc", "_no"
    for rule in catalogue.text_rules:
        if rule.category in PEM_MARKERS:
            df = collapse_pem(df, doc, line_no, line, rule)
        elif rule.category == "sql_query":
            # The gate reads the document as it came, blocks of other rules included.
            gated = raw.filter(F.expr(T.gate(f"lower({line})", rule))).select(F.col(doc).alias("_gated")).distinct()
            df = collapse_sql(df, doc, line_no, line, rule, gated)
        else:
            raise ValueError(f"rule {rule.rule_id} spans lines; apply it to whole documents")
    return df.drop("_doc", "_no")
