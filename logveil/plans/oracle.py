"""The same results as portable SQL, to check the Spark queries against another engine.

These statements are built from the rule catalogue but share no code with the
Spark expressions: regular expressions run in another dialect, lines are rows,
numbers come from ``row_number`` and are put in by joins.
"""

from __future__ import annotations

from logveil.functions.rules import UNIQUE, Catalogue, Rule, pseudonym_format
from logveil.sources import synth

OPEN, CLOSE, CUT = "\x01", "\x02", "\x04"
SYMBOL = f"0{OPEN}([^{CLOSE}]*){CLOSE}0"

LOG_LINES = (
    f"SELECT cast((e - e % {synth.LINES_PER_DOC}) / {synth.LINES_PER_DOC} AS bigint) AS doc_id, "
    f"e % {synth.LINES_PER_DOC} + 1 AS line_no, {synth.portable(synth.line_expression())} AS line "
    "FROM (SELECT event_id AS e, user_id AS u FROM events) AS source")
LOG_DOCS = ("SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text "
            f"FROM ({LOG_LINES}) AS log_lines GROUP BY doc_id")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regex(rule: Rule) -> str:
    return lit(("(?i)" if rule.ignore_case else "") + rule.pattern)


def gate(lowered: str, rule: Rule) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {lit(k)})" for k in rule.keywords) + ")"


def _group(text: str, rule: Rule, group: int) -> str:
    return f"list_transform(regexp_extract_all({text}, {regex(rule)}, {group}), lambda x: coalesce(x, ''))"


def _concat_groups(text: str, rule: Rule, groups) -> str:
    first, *others = (_group(text, rule, g) for g in groups)
    for other in others:
        first = f"list_transform(list_zip({first}, {other}), lambda x: x[1] || x[2])"
    return first


def values(text: str, rule: Rule) -> str:
    if not rule.keeps_prefix:
        return _group(text, rule, 0)
    if rule.value_groups:
        return _concat_groups(text, rule, rule.value_groups)
    return (f"list_transform(list_zip({_group(text, rule, 0)}, {_concat_groups(text, rule, rule.prefix_groups)}), "
            "lambda x: substr(x[1], length(x[2]) + 1))")


def _kept(rule: Rule) -> str:
    return "".join(f"\\{g}" for g in rule.prefix_groups) if rule.keeps_prefix else ""


def masked(text: str, rule: Rule) -> str:
    replacement = _kept(rule) + rule.literal.replace("\\", "\\\\")
    return f"regexp_replace({text}, {regex(rule)}, {lit(replacement)}, 'g')"


def _woven(text: str, pattern: str, kept: str, substitutes: str) -> str:
    return (f"array_to_string(list_transform(list_zip(string_split(regexp_replace({text}, {pattern}, "
            f"{lit(kept + CUT)}, 'g'), {lit(CUT)}), {substitutes}), lambda x: x[1] || coalesce(x[2], '')), '')")


def symbolic(text: str, rule: Rule) -> str:
    before, _, after = pseudonym_format(rule.category)
    head, tail = rule.literal.split(UNIQUE)
    puts = (f"list_transform({values(text, rule)}, lambda v: {lit(head + before + '0' + OPEN + rule.category + '=')} "
            f"|| hex(v) || {lit(CLOSE + '0' + after + tail)})")
    return _woven(text, regex(rule), _kept(rule), puts)


def pseudonym(category: str, number: str, categories: list[str]) -> str:
    branches = []
    for c in categories:
        before, _, after = pseudonym_format(c)
        branches.append(f"WHEN {lit(c)} THEN {lit(before)} || {number_text(lit(c), number)} || {lit(after)}")
    return f"CASE {category} {' '.join(branches)} END"


def number_text(category: str, number: str) -> str:
    n = f"cast({number} AS varchar)"
    return f"(CASE WHEN {category} = 'internal_ip' OR {number} >= 100 THEN {n} ELSE lpad({n}, 3, '0') END)"


def resolved(source: str, unit: list[str], text: str, dictionary: str, other: list[str]) -> str:
    """``source`` with the symbols in ``text`` replaced by numbers of ``dictionary``."""
    keys = ", ".join(unit)
    on = " AND ".join(f"s.{k} = n.{k}" for k in unit)
    found = (f"SELECT {keys}, scope, unnest(regexp_extract_all({text}, {lit(SYMBOL)}, 1)) AS symbol, "
             f"generate_subscripts(regexp_extract_all({text}, {lit(SYMBOL)}, 1), 1) AS at FROM {source}")
    numbers = (f"SELECT {', '.join('f.' + k for k in unit)}, list(d.number ORDER BY f.at) AS numbers FROM ({found}) f "
               f"JOIN {dictionary} d ON f.scope = d.scope AND f.symbol = d.body GROUP BY {', '.join('f.' + k for k in unit)}")
    columns = ", ".join(f"s.{c}" for c in [*unit, *[o for o in other if o not in unit]])
    return (f"SELECT {columns}, CASE WHEN n.numbers IS NULL THEN s.{text} ELSE "
            f"{_woven('s.' + text, lit(SYMBOL), '', 'n.numbers')} END AS {text} "
            f"FROM {source} s LEFT JOIN ({numbers}) n ON {on}")


def cascade(docs: str, catalogue: Catalogue, scope: str = "doc") -> str:
    """CTEs up to ``redacted(doc_id, text)``, ``hits`` and ``dictionary``; starts with WITH."""
    ctes = [("docs", docs), ("t0", "SELECT doc_id, text, lower(text) AS low FROM docs")]
    hits, previous, dictionaries = [], "t0", []
    for r in catalogue.text_rules:
        name = f"t{r.rule_id + 1}"
        ctes.append((name, f"SELECT doc_id, CASE WHEN {gate('low', r)} THEN {masked('text', r)} ELSE text END AS text, "
                           f"low FROM {previous}"))
        hits.append((r, f"SELECT doc_id, cast(NULL AS bigint) AS line_no, "
                        f"{values('text', r)} AS found FROM {previous} WHERE {gate('low', r)}"))
        previous = name
    scope_sql = "cast(doc_id AS varchar)" if scope == "doc" else "'corpus'"
    ctes.append(("lines", f"SELECT doc_id, {scope_sql} AS scope, unnest(string_split(text, chr(10))) AS line, "
                          f"generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {previous}"))
    bits = [f"g{r.rule_id}" for r in catalogue.line_rules]
    gates = [f"{gate('lower(line)', r)} AS g{r.rule_id}" for r in catalogue.line_rules]
    ctes.append(("gated", f"SELECT {', '.join(['doc_id', 'scope', 'line_no', 'line', *gates])} FROM lines"))
    previous = "gated"
    carried = ["doc_id", "scope", "line_no", *bits]
    for number, rules in enumerate(catalogue.stages()):
        unique = []
        for r in rules:
            rewrite = symbolic if r.is_unique else masked
            name = f"r{r.rule_id}"
            hits.append((r, f"SELECT doc_id, line_no, {values('line', r)} AS found FROM {previous} WHERE g{r.rule_id}"))
            if r.is_unique:
                unique.append(f"SELECT scope, line_no, {r.rule_id} AS rule, {lit(r.category)} AS category, "
                              f"unnest({values('line', r)}) AS original, "
                              f"generate_subscripts({values('line', r)}, 1) AS pos FROM {previous} WHERE g{r.rule_id}")
            ctes.append((name, f"SELECT {', '.join(carried)}, CASE WHEN g{r.rule_id} THEN {rewrite('line', r)} "
                               f"ELSE line END AS line FROM {previous}"))
            previous = name
        if unique:
            seen = ("SELECT scope, category, original, min(struct_pack(l := line_no, r := rule, p := pos)) AS seen "
                    f"FROM ({' UNION ALL '.join(unique)}) GROUP BY scope, category, original")
            order = "seen" if scope == "doc" else "md5(original), original"
            # A category that an earlier stage numbered goes on from there.
            before, lookup = "", f"d{number}"
            if dictionaries:
                ctes.append((f"e{number}", " UNION ALL ".join(dictionaries)))
                ctes.append((f"w{number}", resolved(f"e{number}", ["scope", "body"], "original", f"e{number}",
                                                    ["category", "id", "number", "replacement"])))
                seen = f"SELECT s.* FROM ({seen}) s ANTI JOIN w{number} w USING (scope, category, original)"
                before = (f" + coalesce((SELECT max(w.id) FROM w{number} w WHERE w.scope = seen_values.scope "
                          "AND w.category = seen_values.category), 0)")
                lookup = f"l{number}"
            ctes.append((f"numbered{number}", f"SELECT *, row_number() OVER (PARTITION BY scope, category ORDER BY {order})"
                                              f"{before} AS id FROM ({seen}) AS seen_values"))
            body = "category || '=' || hex(original) AS body"
            ctes.append((f"d{number}", f"SELECT scope, category, original, id, {body}, "
                                       f"{number_text('category', 'id')} AS number, "
                                       f"{pseudonym('category', 'id', catalogue.unique_categories)} AS replacement FROM numbered{number}"))
            if dictionaries:
                ctes.append((lookup, f"SELECT scope, body, number FROM d{number} UNION ALL SELECT scope, {body}, number FROM w{number}"))
            dictionaries.append(f"SELECT * FROM d{number}")
            ctes.append((f"s{number}", resolved(previous, ["doc_id", "line_no"], "line", lookup, carried)))
            previous = f"s{number}"
    ctes.append(("redacted", f"SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM {previous} GROUP BY doc_id"))
    if dictionaries:
        ctes.append(("entries", " UNION ALL ".join(dictionaries)))
        ctes.append(("dictionary", resolved("entries", ["scope", "body"], "original", "entries",
                                            ["category", "id", "replacement"])))
    ctes.append(("hits", " UNION ALL ".join(
        f"SELECT doc_id, line_no, {r.rule_id} AS rule, {lit(r.category)} AS category, cast(len(found) AS bigint) AS n "
        f"FROM ({sql}) AS found{r.rule_id} WHERE len(found) > 0" for r, sql in hits)))
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n"


# --- one rule by itself ---------------------------------------------------------

def detect(source: str, keys: list[str], text: str, rule: Rule) -> str:
    found = f"SELECT {', '.join(keys)}, {values(text, rule)} AS found FROM ({source}) AS src WHERE {gate(f'lower({text})', rule)}"
    return (f"SELECT {', '.join(keys)}, {rule.rule_id} AS rule, {lit(rule.category)} AS category, "
            f"cast(generate_subscripts(found, 1) AS bigint) AS pos, unnest(found) AS original FROM ({found}) AS found_in")


def count(source: str, text: str, rule: Rule) -> str:
    return (f"SELECT {rule.rule_id} AS rule, {lit(rule.category)} AS category, cast(coalesce(sum(len("
            f"regexp_extract_all({text}, {regex(rule)}))), 0) AS bigint) AS n FROM ({source}) AS src "
            f"WHERE {gate(f'lower({text})', rule)}")
