"""Redaction of logs kept as lines, in one scan over chunks of lines.

A chunk is a row with up to ``LINES_PER_CHUNK`` consecutive lines of a document,
so the cascade runs on it as it does on a document, and lines without any
candidate cost nothing.  What spans lines may begin in one chunk and end in
another.  Each chunk is therefore summed up as a function: for every state in
which it can be entered, the state in which it is left.  A state says whether a
private key or a certificate is open, whether the end of one is still to come,
and whether the line before belongs to an SQL statement.  The functions are
composed over the chunks of a document, on rows of a few bytes: first those of
the PEM blocks, then, for the state that these give each chunk, that of the SQL
statements.  With its state known each chunk is rewritten once.

The result is that of ``redact_documents`` on the joined lines, but that the
lines keep their numbers: a block stays on the line where it began, and what
follows its end on the same line is put behind it.  Lines that a block swallows
are gone.  A line that holds line feeds is several lines to the rules, and one
row again in the end.  A missing line stays missing.  A hit on a block has no
line number and carries the first line of the block as far as its chunk shows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue, Rule
from logveil.operators import cascade
from logveil.operators.blocks import BROADCAST_BYTES, BROADCAST_ROWS, PEM_MARKERS, SQL_CONTINUED, SQL_START
from logveil.operators.pseudonyms import CORPUS, DOC, Lookup, everything, readable
from logveil.operators.redact import Redaction, across_narrow
from logveil.sources.staging import staged

LINES_PER_CHUNK = 2048

# The state in which a chunk is entered, as bits: per kind of PEM block whether one
# is open, and whether an end comes after the chunk.
_OPEN, _LATER = {"private_key": 1, "certificate": 4}, {"private_key": 2, "certificate": 8}
_PLACE = rf"{T.OPEN}(\d+){T.CLOSE}"


@dataclass
class LineRedaction(Redaction):
    """``findings`` are ``(doc, line_no, rule, category, pos, original)``; ``rows`` have no column of hits."""

    findings: DataFrame


# --- what spans lines, as expressions ------------------------------------------

def _bit(state: str, bit: int) -> str:
    return f"({state} & {bit}) != 0"


def _pem(text: str, state: str, rule: Rule, catalogue: Catalogue) -> tuple[str, str]:
    """A chunk's text without blocks of one kind, null if it lies inside one; and the blocks found, first lines only."""
    begin, end = PEM_MARKERS[rule.category]
    regex, marker = catalogue.regex(rule), T.quote_replacement(rule.replacement)
    opened, later = _bit(state, _OPEN[rule.category]), _bit(state, _LATER[rule.category])
    cut = T.when(f"NOT {opened}", "t", T.when(T.matches("t", end), T.substitute("t", rf"\A[\s\S]*?{end}", "")))
    closed = T.substitute("c", regex, marker)
    left = T.when(later, T.substitute("d", rf"{begin}[\s\S]*\z", marker), "d")
    whole = T.let("t", text, T.let("c", cut, T.let("d", closed, left)))
    unclosed = T.when(later, f"slice(regexp_extract_all({closed}, {T.literal(begin + '[^' + chr(10) + ']*')}, 0), 1, 1)", "array()")
    found = T.let("t", text, T.let("c", cut, f"concat(regexp_extract_all(c, {T.literal(regex)}, 0), {unclosed})"))
    return whole, found


def _pem_rules(catalogue: Catalogue) -> list[Rule]:
    return [r for r in catalogue.text_rules if r.category in PEM_MARKERS]


def _without_pem(text: str, state: str, catalogue: Catalogue) -> str:
    for rule in _pem_rules(catalogue):
        text, _ = _pem(text, state, rule, catalogue)
    return text


def _flag(line: str) -> str:
    """0 for a line that ends a statement, 1 for one that only continues it, 2 if it only starts one, 3 if it does both."""
    starts, continues = T.matches(line, SQL_START), T.matches(line, SQL_CONTINUED)
    return f"CASE WHEN {starts} THEN IF({continues}, '3', '2') WHEN {continues} THEN '1' ELSE '0' END"


def _exit(flags: str) -> str:
    """How lines leave an SQL statement: 0 outside, 2 inside, 1 as they were entered."""
    return T.let("deciding", f"regexp_extract({flags}, '([023])1*\\\\z', 1)",
                 "CASE deciding WHEN '' THEN '1' WHEN '0' THEN '0' ELSE '2' END")


def _marked(flags: str, inside: str) -> str:
    """Flags with an x for each line that an earlier line's statement swallows."""
    return f"substr({T.substitute(f'''concat(IF({inside}, '2', '0'), {flags})''', r'(?:(?<=[23])|(?!^)\G)[13]', 'x')}, 2)"


def _plain(line: str) -> str:
    """A line without places, as it was."""
    return T.unprotect(T.substitute(line, _PLACE, ""))


def _parts(tagged: str, glued: str) -> str:
    """``(place, line)`` of tagged lines; ``glued`` says that the first of them goes on a line of an earlier chunk."""
    lines = T.let("cut", T.pieces(tagged), f"IF({glued}, slice(cut, 2, greatest(size(cut) - 1, 0)), cut)")
    return (f"transform({lines}, x -> named_struct('place', cast(regexp_extract(x, {T.literal('^' + _PLACE)}, 1) AS int), "
            f"'line', {_plain('x')}))")


_NO_PARTS = "cast(array() AS array<struct<place:int,line:string>>)"
_GLUED = " OR ".join(f"({{0}} & {b}) != 0" for b in _OPEN.values())


# --- chunks and their functions --------------------------------------------------

def chunks(df: DataFrame, doc: str, line_no: str, line: str, catalogue: Catalogue, size: int = LINES_PER_CHUNK) -> DataFrame:
    """``(_doc, _chunk, _rows, _parts, …)``: lines gathered, with all that tells how a chunk changes a state."""
    rest = [c for c in df.columns if c != line]
    rows = df.select(
        F.expr(f"coalesce(concat('=', cast(`{doc}` AS string)), '')").alias("_doc"),
        F.expr(f"floor(coalesce(cast(`{line_no}` AS bigint), 0) / {size})").alias("_chunk"),
        F.struct(F.expr(f"coalesce(cast(`{line_no}` AS bigint), 0)").alias("no"), F.col(line).alias("line"),
                 F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")).alias("_row"))
    df = rows.groupBy("_doc", "_chunk").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    df = df.withColumn("_parts", F.expr(
        "flatten(transform(_rows, (r, i) -> transform(split(coalesce(r.line, ''), '\\n', -1), "
        "l -> named_struct('place', i, 'line', l))))"))
    df = cascade.barrier(
        df, _pem="exists(_parts, p -> contains(p.line, '-----BEGIN ') OR contains(p.line, '-----END '))",
        _gated=" OR ".join(f"exists(_parts, p -> {T.gate('lower(p.line)', r)})" for r in catalogue.text_rules if r.category == "sql_query") or "false",
        _flags=f"array_join(transform(_parts, p -> {_flag('p.line')}), '')")
    tagged = f"array_join(transform(_parts, p -> concat('{T.OPEN}', p.place, '{T.CLOSE}', {T.protect('p.line')})), '\\n')"
    df = cascade.barrier(df, _tagged=T.when("_pem", tagged))
    summaries = {"_exit": _exit("_flags"), "_private": "cast(NULL AS struct<opens:boolean,ends:boolean>)",
                 "_certificate": "cast(NULL AS array<struct<opens:boolean,ends:boolean>>)"}
    kinds = {r.category: r for r in _pem_rules(catalogue)}
    if "private_key" in kinds:
        summaries["_private"] = T.when("_pem", _markers("_tagged", "private_key"))
    if "certificate" in kinds:
        before = _pem("_tagged", "v", kinds["private_key"], catalogue)[0] if "private_key" in kinds else "_tagged"
        summaries["_certificate"] = T.when("_pem", f"transform(sequence(0, 3), v -> {_markers(before, 'certificate')})")
    return cascade.barrier(df, **summaries)


_GONE = "named_struct('out', '1', 'own', false, 'head', cast(NULL AS string))"


def _summary(catalogue: Catalogue) -> str:
    """How a chunk with markers, entered in ``_state``, leaves an SQL statement; whether it has lines of its own; and what goes on an earlier line."""
    glued = _GLUED.format("_state")
    flags = f"array_join(transform(own, p -> {_flag('p.line')}), '')"
    first = "substring_index(t, '\\n', 1)"
    summary = (f"named_struct('out', {_exit(flags)}, 'own', size(own) > 0, "
               f"'head', IF({glued}, nullif({_plain(first)}, ''), NULL))")
    return T.let("t", _without_pem("_tagged", "_state", catalogue), T.when("t IS NULL", _GONE, T.let("own", _parts("t", glued), summary)))


def _markers(text: str, category: str) -> str:
    """Whether the last marker of a kind opens a block, null without markers; and whether any closes one."""
    begin, end = PEM_MARKERS[category]
    found = f"regexp_extract_all({text}, {T.literal(f'{begin}|{end}')}, 0)"
    return T.let("marks", found, "named_struct('opens', startswith(get(marks, size(marks) - 1), '-----BEGIN'), "
                                 "'ends', coalesce(exists(marks, m -> startswith(m, '-----END')), false))")


def entered(chunked: DataFrame, catalogue: Catalogue) -> DataFrame:
    """``(_doc, _chunk, _state, _inside, _tail)``: how each chunk is entered, and what later chunks put behind its last line.

    It reads a row of a few bytes for each chunk, and the lines of those with markers.
    """
    of = Window.partitionBy("_doc")
    before = of.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def state(marks: str, category: str) -> str:
        last_end = F.max(F.expr(f"IF({marks}.ends, _chunk, NULL)")).over(of)
        last = F.max(F.expr(f"IF({marks}.opens IS NULL, NULL, struct(_chunk, {marks}.opens AS opens))")).over(before)
        opened = F.coalesce(last["opens"] & (last_end >= F.col("_chunk")), F.lit(False))
        later = F.coalesce(last_end > F.col("_chunk"), F.lit(False))
        return F.when(opened, _OPEN[category]).otherwise(0) + F.when(later, _LATER[category]).otherwise(0)

    rows = chunked.select("_doc", "_chunk", "_pem", "_gated", "_exit", "_private", "_certificate")
    rows = rows.withColumn("_state", state("_private", "private_key"))
    rows = rows.withColumn("_seen", F.expr("get(_certificate, _state)"))
    rows = rows.withColumn("_state", F.col("_state") + state("_seen", "certificate")).drop("_private", "_certificate", "_seen")
    rows = staged(rows, "pem-states")
    marked = chunked.filter("_pem").select("_doc", "_chunk", "_tagged").join(rows.filter("_pem").select("_doc", "_chunk", "_state"), ["_doc", "_chunk"])
    rows = rows.join(marked.select("_doc", "_chunk", F.expr(_summary(catalogue)).alias("_known")), ["_doc", "_chunk"], "left")
    rows = rows.withColumn("_as", F.expr(
        f"CASE WHEN _pem THEN _known WHEN {_GLUED.format('_state')} THEN {_GONE} "
        "ELSE named_struct('out', _exit, 'own', true, 'head', cast(NULL AS string)) END"))
    decided = F.max(F.expr("IF(_as.out = '1', NULL, struct(_chunk, _as.out AS out))")).over(before)
    rows = rows.withColumns({
        "_gated": F.max("_gated").over(of), "_target": F.max(F.expr("IF(_as.own, _chunk, NULL)")).over(before),
        "_inside": F.coalesce(decided["out"] == "2", F.lit(False))})
    rows = staged(rows.select("_doc", "_chunk", "_state", "_gated", F.expr("_inside AND _gated").alias("_inside"), "_target",
                              F.col("_as.head").alias("_head")), "states")
    tails = rows.filter("_head IS NOT NULL AND NOT _inside").groupBy("_doc", F.col("_target").alias("_chunk")).agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(_chunk, _head))), x -> x._head), '')").alias("_tail"))
    return rows.drop("_target", "_head").join(tails, ["_doc", "_chunk"], "left")


def collapsed(chunked: DataFrame, states: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Chunks with ``_parts`` as the rules that span lines leave them, and with ``_blocks``, the hits of these rules."""
    size, tails = states.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_tail")), F.lit(0))).first()
    if size <= BROADCAST_ROWS and tails <= BROADCAST_BYTES:
        states = F.broadcast(states)
    df = chunked.drop("_gated", "_exit", "_private", "_certificate").join(states, ["_doc", "_chunk"])
    glued = _GLUED.format("_state")
    text, found = "_tagged", []
    for rule in _pem_rules(catalogue):
        text, blocks = _pem(text, "_state", rule, catalogue)
        found.append(_block_hits(f"coalesce({blocks}, array())", rule, _plain("substring_index(v, '\\n', 1)")))
    parts = T.when("_pem", T.let("t", text, T.when("t IS NULL", _NO_PARTS, _parts("t", glued))), T.when(glued, _NO_PARTS, "_parts"))
    no_hits = "cast(array() AS array<struct<rule:int,category:string,pos:int,original:string>>)"
    df = cascade.barrier(df, _own=parts, _blocks=T.when("_pem", f"concat({', '.join([no_hits, *found])})", no_hits))
    sql = next((r for r in catalogue.text_rules if r.category == "sql_query"), None)
    if sql:
        flags = T.when("_pem", f"array_join(transform(_own, p -> {_flag('p.line')}), '')", T.when("size(_own) > 0", "_flags", "''"))
        df = cascade.barrier(df, _marks=T.when("_gated", f"split({_marked(flags, '_inside')}, '')"))
        begun = "filter(_own, (p, i) -> get(_marks, i) IN ('2', '3'))"
        kept = ("filter(transform(_own, (p, i) -> CASE get(_marks, i) WHEN 'x' THEN NULL WHEN '0' THEN p WHEN '1' THEN p ELSE "
                f"named_struct('place', p.place, 'line', {T.literal(sql.replacement)}) END), p -> p IS NOT NULL)")
        df = cascade.barrier(
            df, _own=T.when("_gated", kept, "_own"),
            _blocks=T.when("_gated", f"concat(_blocks, {_block_hits(f'transform({begun}, p -> p.line)', sql, 'v')})", "_blocks")).drop("_marks")
    behind = "transform(_own, (p, i) -> IF(i = size(_own) - 1, named_struct('place', p.place, 'line', concat(p.line, _tail)), p))"
    return cascade.barrier(df, _parts=T.when("_tail IS NOT NULL", behind, "_own")).drop("_own", "_tagged", "_pem", "_flags", "_state", "_gated", "_inside", "_tail")


def _block_hits(values: str, rule: Rule, original: str) -> str:
    return (f"transform({values}, (v, i) -> named_struct('rule', {rule.rule_id}, 'category', {T.literal(rule.category)}, "
            f"'pos', i + 1, 'original', {original}))")


# --- the whole ----------------------------------------------------------------------

def _as_lines(df: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """One row for each line that is left, with the columns of the input."""
    pairs = f"zip_with(_places, {T.pieces('_chunk_text')}, (place, l) -> named_struct('place', place, 'line', l))"
    several = ("transform(array_distinct(_places), i -> named_struct('place', i, 'line', "
               "array_join(transform(filter(pairs, p -> p.place = i), p -> p.line), '\\n')))")
    lines = T.let("pairs", pairs, f"IF(size(array_distinct(_places)) = size(_places), pairs, {several})")
    row = "get(_rows, p.place)"
    rows = (f"transform({T.when('size(_places) > 0', lines, _NO_PARTS)}, p -> named_struct('row', {row}, "
            f"'line', IF({row}.missing, NULL, p.line)))")
    return df.select(F.expr(f"inline({rows})")).select(
        *[F.col("line").alias(c) if c == line else F.col(f"row.rest.`{c}`").alias(c) for c in columns])


def redact_lines_scan(df: DataFrame, doc_col: str, line_no_col: str, line_col: str, scope: str = DOC,
                      catalogue: Catalogue | None = None, known: DataFrame | Lookup | None = None,
                      lines_per_chunk: int = LINES_PER_CHUNK) -> LineRedaction:
    """Redact a log kept as lines, of any length, as ``redact_documents`` would redact the whole of it.

    ``rows`` has the columns of ``df``; those beside the line must be of types that can be ordered.
    """
    catalogue = catalogue or Catalogue.builtin()
    for rule in catalogue.text_rules:
        if rule.category not in PEM_MARKERS and rule.category != "sql_query":
            raise ValueError(f"rule {rule.rule_id} spans lines; apply it to whole documents")
    chunked = staged(chunks(df, doc_col, line_no_col, line_col, catalogue, lines_per_chunk), "chunks")
    done = collapsed(chunked, entered(chunked, catalogue), catalogue)
    done = cascade.barrier(done, _chunk_text="array_join(transform(_parts, p -> p.line), '\\n')", _places="transform(_parts, p -> p.place)",
                           _rows="transform(_rows, r -> named_struct('no', r.no, 'missing', r.line IS NULL, 'rest', r.rest))")
    line_rules = catalogue.select(rule_ids=[r.rule_id for r in catalogue.line_rules])
    base = cascade.start(done.drop("_parts"), "_chunk_text", line_rules) \
        .withColumn("_scope", F.expr("substr(_doc, 2)") if scope == DOC else F.lit(CORPUS))
    busy, entries = across_narrow(base, line_rules, ["_chunk"], scope, f"_chunk * {lines_per_chunk}", known)
    busy = cascade.finish(busy, "_chunk_text").drop("_scope")
    hits = ("concat(transform(_blocks, b -> named_struct('line_no', cast(NULL AS bigint), 'rule', b.rule, 'category', b.category, "
            "'pos', b.pos, 'original', b.original)), transform(hits, h -> named_struct('line_no', "
            "get(_rows, get(_places, cast(h.line_no - 1 AS int))).no, 'rule', h.rule, 'category', h.category, 'pos', h.pos, "
            "'original', h.original)))")
    found = busy.select(F.expr("get(_rows, 0).rest").alias("_rest"), F.expr(f"inline({hits})")) \
        .select(F.col(f"_rest.`{doc_col}`").alias(doc_col), "line_no", "rule", "category", "pos", "original")
    return LineRedaction(_as_lines(busy, line_col, df.columns), None if entries is None else readable(entries, everything(known)), entries, found)
