"""The ordered cascade of rules over rows of text, as narrow expressions.

A row is a *unit*: a document with all its lines, or a single line of a huge
log.  Rule *n* reads what rule *n-1* left.  Nothing here shuffles.  Numbers of
pseudonyms stay symbolic within a stage (see ``Catalogue.stages``); the callers
decide where the numbers come from.

Working columns: ``_text`` the lines that some rule may change, ``_mask`` their
gates as bits, ``_rest`` the text around them, ``_line_nos`` their places, and
``_hits`` the matches found so far, in the order line, rule, position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions import text as T
from logveil.functions.rules import Catalogue, Rule

HITS = "array<struct<place:int,rule:int,category:string,pos:int,original:string>>"
WORKING = ("_text", "_mask", "_rest", "_line_nos", "_hits")
_NO_HITS = f"cast(array() AS {HITS})"


def _hits(values: str, rule: Rule, place: str) -> str:
    return (f"transform({values}, (v, i) -> named_struct('place', {place}, 'rule', {rule.rule_id}, "
            f"'category', {T.literal(rule.category)}, 'pos', i + 1, 'original', v))")


def barrier(df: DataFrame, **columns: str) -> DataFrame:
    """Add or replace columns that later filters must read rather than repeat.

    The optimizer moves a filter below the projections that compute what it reads
    by copying their expressions into it, which for the cascade multiplies work
    beyond measure.  It does not look through a generator, so the columns are
    made by one that gives exactly one row.
    """
    kept = [c for c in df.columns if c not in columns]
    made = ", ".join(f"{T.literal(n)}, {e}" for n, e in columns.items())
    return df.select(*[F.col(f"`{c}`") for c in kept], F.expr(f"inline(array(named_struct({made})))")) \
        .select(*[f"`{c}`" for c in dict.fromkeys([*df.columns, *columns])])


def start(df: DataFrame, text: str, catalogue: Catalogue) -> DataFrame:
    """Run the whole-text rules and set the lines apart that line rules may change."""
    df = df.withColumns({"_text": F.expr(T.protect(text)), "_low": F.expr(f"lower({text})"), "_hits": F.expr(_NO_HITS)})
    for rule in catalogue.text_rules:
        regex, passed = catalogue.regex(rule), T.gate("_low", rule)
        found = _hits(T.match_values("_text", rule, regex), rule, "cast(NULL AS int)")
        df = df.withColumns({
            "_text": F.expr(T.when(passed, T.masked("_text", rule, regex), "_text")),
            "_hits": F.expr(T.when(passed, f"concat(_hits, {found})", "_hits"))})
    crlf = f"contains(_text, '\\r\\n') AND {T.any_contains('_low', catalogue.keywords)}"
    df = df.withColumn("_text", F.expr(T.when(crlf, T.normalise_line_ends("_text"), "_text")))

    cut = T.literal(T.CUT)
    df = df.withColumn("_marked", F.expr(T.substitute("_text", T.candidate_regex(catalogue), T.CUT + "$0")))
    df = df.withColumn("_pieces", F.expr(T.when(f"contains(_marked, {cut})", T.pieces("_marked"))))
    lines = f"filter(_pieces, piece -> contains(piece, {cut}))"
    rest = f"array_join(transform(_pieces, piece -> IF(contains(piece, {cut}), {cut}, piece)), '\\n')"
    places = f"filter(transform(_pieces, (piece, i) -> IF(contains(piece, {cut}), i + 1, NULL)), n -> n IS NOT NULL)"
    df = barrier(df, _rest=T.when("_pieces IS NOT NULL", T.pieces(rest, T.CUT), "array(_text)"), _line_nos=places,
                 _lines=T.when("_pieces IS NOT NULL", lines, "IF(_text IS NULL, NULL, cast(array() AS array<string>))"))
    return _with_masks(df, catalogue).drop("_low", "_marked", "_pieces")


def start_lines(df: DataFrame, line: str, line_no: str, catalogue: Catalogue) -> DataFrame:
    """The same for rows that are single lines, all of them candidates; line feeds within one keep their places."""
    marked = T.substitute(T.protect(line), T.candidate_regex(catalogue), T.CUT + "$0")
    df = df.withColumn("_lines", F.expr(T.let("marked", marked, f"coalesce({T.pieces('marked')}, array(marked))")))
    df = df.withColumns({
        "_hits": F.expr(_NO_HITS), "_rest": F.expr("transform(_lines, (l, i) -> IF(i = 0, '', '\\n'))"),
        "_line_nos": F.expr(f"array_repeat({line_no}, size(_lines))")})
    return _with_masks(df, catalogue)


def _with_masks(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """``_text`` and ``_mask`` from the marked lines in ``_lines``."""
    unmarked = f"replace(marked, {T.literal(T.CUT)}, '')"
    mask = T.let("low", f"lower({unmarked})", T.gate_mask("low", catalogue.line_rules, "marked"))
    return df.withColumns({
        "_text": F.expr(f"replace(array_join(_lines, '\\n'), {T.literal(T.CUT)}, '')"),
        "_mask": F.expr(f"transform(_lines, marked -> {mask})")}).drop("_lines")


def _bits(rules: list[Rule], catalogue: Catalogue) -> int:
    return sum(1 << catalogue.line_rules.index(r) for r in rules)


def _apply(rule: Rule, catalogue: Catalogue) -> str:
    """One rule on one line; the state ``s`` holds the line and its hits, ``place`` is the line's."""
    regex = catalogue.regex(rule)
    state = lambda text: f"named_struct('t', {text}, 'h', concat(s.h, {_hits('vals', rule, 'place')}))"
    if T.is_cut_at_once(rule):
        changed = T.let("vals", T.cut_values("cut"), state(T.cut_rewritten("cut", rule)))
        return T.let("cut", T.cut_at_values("s.t", rule, regex), T.when("size(cut) = 1", "s", changed))
    rewritten = T.symbolic("s.t", rule, regex, "vals") if rule.is_unique else T.masked("s.t", rule, regex)
    return T.let("vals", T.match_values("s.t", rule, regex), T.when("size(vals) = 0", "s", state(rewritten)))


def run_stage(df: DataFrame, rules: list[Rule], catalogue: Catalogue) -> DataFrame:
    """Apply ``rules`` in order to every line; numbers of new pseudonyms stay symbolic.

    A line is folded over those rules whose gates it has passed.  Nesting all
    rules instead costs each line the square of their number, as an expression
    asks those inside it for their type whenever it is evaluated.
    """
    bits = {r: f"{_bits([r], catalogue)}L" for r in rules}
    begun = f"named_struct('t', l.t, 'h', {_NO_HITS})"
    step = f"CASE b {' '.join(f'WHEN {bit} THEN {_apply(r, catalogue)}' for r, bit in bits.items())} ELSE s END"
    due = f"filter(array({', '.join(bits.values())}), b -> (l.m & b) != 0)"
    done = (f"transform(zip_with({T.pieces('_text')}, _mask, (t, m) -> named_struct('t', t, 'm', m)), (l, place) -> "
            f"{T.when(f'(l.m & {_bits(rules, catalogue)}L) = 0', begun, f'aggregate({due}, {begun}, (s, b) -> {step})')})")
    return df.withColumn("_lines", F.expr(done)).withColumns({
        "_text": F.expr("array_join(transform(_lines, l -> l.t), '\\n')"),
        "_hits": F.expr("concat(_hits, flatten(transform(filter(_lines, l -> size(l.h) > 0), l -> l.h)))"),
    }).drop("_lines")


def finish(df: DataFrame, text_name: str) -> DataFrame:
    """Replace the working columns by the redacted text and its hits."""
    plain = ("transform(_hits, h -> named_struct('line_no', cast(get(_line_nos, h.place) AS bigint), "
             "'rule', h.rule, 'category', h.category, 'pos', h.pos, "
             f"'original', {T.unprotect('h.original')}))")
    whole = (f"array_join(zip_with(_rest, {T.pieces('_text')}, "
             "(around, line) -> concat(around, coalesce(line, ''))), '')")
    df = barrier(df, _text=T.when("_text IS NULL", "cast(NULL AS string)", whole), hits=plain)
    return df.withColumn(text_name, F.expr(T.unprotect("_text"))).drop(*WORKING)


def symbolic_keys(hits: str, rules: list[Rule]) -> str:
    """Bodies of the symbols that ``rules`` put into the text, in first-seen order, each once."""
    ids = ", ".join(str(r.rule_id) for r in rules if r.is_unique)
    return (f"array_distinct(transform(filter({hits}, h -> h.rule IN ({ids})), "
            f"h -> {T.symbol_body('h.category', 'h.original')}))")
