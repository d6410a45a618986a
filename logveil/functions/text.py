"""SQL expressions over text: gates, matches, masks, lines and symbolic pseudonyms.

Every function takes SQL expressions as strings (a column name is one) and
returns a SQL expression to be used with ``F.expr`` or ``selectExpr``, in batch
and streaming queries alike.  Composing strings keeps the deeply nested
expressions of the cascade cheap to build: they are parsed once, on the JVM.
"""

from __future__ import annotations

from logveil.functions.rules import UNIQUE, Catalogue, Rule, is_builtin, pseudonym_format

# Control characters that logs do not hold.  OPEN and CLOSE frame a symbolic
# pseudonym, CUT marks a place, ESCAPE protects raw occurrences.  They are in
# ASCII, so that text which was in one byte per character stays so.
OPEN, CLOSE, ESCAPE, CUT = "\x01", "\x02", "\x03", "\x04"
_WORKING = OPEN + CLOSE + ESCAPE + CUT
# Unicode noncharacters that stand for raw working characters, one for one.
_STAND_INS = "\ufdd0\ufdd1\ufdd2\ufdd3"
# What follows ESCAPE for each of them, in texts that hold noncharacters as well.
_SAFE = dict(zip(ESCAPE + OPEN + CLOSE + CUT + _STAND_INS, "\x05\x06\x07\x08\x0e\x0f\x10\x11"))
WORKING_CHARACTERS = tuple(_WORKING + _STAND_INS)

# The number of a symbolic pseudonym.  The two zeros keep word boundaries as they
# are beside a real number.
SYMBOL = f"0{OPEN}([^{CLOSE}]*){CLOSE}0"


def literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def string_array(values) -> str:
    return "array(" + ", ".join(map(literal, values)) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once, inside a lambda too."""
    return f"transform(array({value}), {name} -> {body})[0]"


def when(condition: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {otherwise} END"


def quote_replacement(text: str) -> str:
    """Literal text as a replacement string of the regexp functions."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def substitute(text: str, regex: str, replacement: str) -> str:
    return f"regexp_replace({text}, {literal(regex)}, {literal(replacement)})"


def pieces(text: str, separator: str = "\n") -> str:
    return f"split({text}, {literal(separator)}, -1)"


# --- gates ------------------------------------------------------------------

def any_contains(lowered: str, needles) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {literal(n)})" for n in needles) + ")"


def gate(lowered: str, rule: Rule) -> str:
    """May ``rule`` run on a text whose lower-case form is ``lowered``?"""
    return any_contains(lowered, rule.keywords)


def may_have_matches(text: str, catalogue: Catalogue) -> str:
    """Does any keyword of any rule occur in the text?"""
    return let("low", f"lower({text})", any_contains("low", catalogue.keywords))


def present_keywords(text: str, catalogue: Catalogue) -> str:
    """The keywords that occur in the text, sorted."""
    return let("low", f"lower({text})",
               f"filter({string_array(catalogue.keywords)}, k -> contains(low, k))")


def applicable_rules(line: str, catalogue: Catalogue) -> str:
    """Ids of the line rules whose gate a line passes, in order."""
    passing = ", ".join(when(gate("low", r), str(r.rule_id)) for r in catalogue.line_rules)
    return let("low", f"lower({line})", f"array_compact(array({passing}))")


def gate_mask(lowered: str, rules: list[Rule], marked: str | None = None) -> str:
    """The gates of ``rules`` as bits, bit ``i`` for the i-th rule.

    With ``marked``, the line with its candidate places marked, gates of rules
    that cannot match on it are not tried: a rule has an anchor character, and
    what earlier rules put in never makes a match at an anchor that was not there.
    """
    bit = lambda i, r: f"IF({gate(lowered, r)}, {1 << i}L, 0L)"
    if marked is None:
        return " | ".join(bit(i, r) for i, r in enumerate(rules)) or "0L"
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(_ANCHORS.get(r.rule_id, "") if is_builtin(r) else "", []).append(bit(i, r))
    tried = []
    for anchors, bits in groups.items():
        if anchors:
            tried.append(f"IF({any_contains(marked, [CUT + a for a in anchors])}, {' | '.join(bits)}, 0L)")
        else:
            tried.extend(bits)
    return " | ".join(tried) or "0L"


# --- matches of one rule ----------------------------------------------------

def _group(text: str, regex: str, index: int) -> str:
    return f"regexp_extract_all({text}, {literal(regex)}, {index})"


def _joined_groups(text: str, regex: str, groups: tuple[int, ...]) -> str:
    """Per match, the group of ``groups`` that took part (the others are empty)."""
    joined = _group(text, regex, groups[0])
    for g in groups[1:]:
        joined = f"zip_with({joined}, {_group(text, regex, g)}, (ga, gb) -> concat(ga, gb))"
    return joined


def match_values(text: str, rule: Rule, regex: str) -> str:
    """Per match, the sensitive value: the match without the prefix that is kept."""
    if not rule.keeps_prefix:
        return _group(text, regex, 0)
    if rule.value_groups:
        return _joined_groups(text, regex, rule.value_groups)
    return (f"zip_with({_group(text, regex, 0)}, {_joined_groups(text, regex, rule.prefix_groups)}, "
            f"(whole, prefix) -> substr(whole, length(prefix) + 1))")


def match_count(text: str, regex: str) -> str:
    return f"regexp_count({text}, {literal(regex)})"


def matches(text: str, regex: str) -> str:
    return f"({text} RLIKE {literal(regex)})"


def _prefix_reference(rule: Rule) -> str:
    return "".join(f"${g}" for g in rule.prefix_groups) if rule.keeps_prefix else ""


def masked(text: str, rule: Rule, regex: str) -> str:
    """The text with every match replaced by the rule's fixed marker."""
    return substitute(text, regex, _prefix_reference(rule) + quote_replacement(rule.literal))


def replace_each(text: str, regex: str, kept: str, substitutes: str) -> str:
    """Replace the n-th match by the n-th of ``substitutes``, keeping ``kept`` group references."""
    return (f"array_join(zip_with({pieces(substitute(text, regex, kept + CUT), CUT)}, {substitutes}, "
            f"(piece, put) -> concat(piece, coalesce(put, ''))), '')")


# --- symbolic pseudonyms ----------------------------------------------------

def symbol_body(category: str, value: str) -> str:
    """What a symbolic number carries: its category and its value, as characters no rule reacts to."""
    return f"concat({category}, '=', hex({value}))"


def _stand_in(rule: Rule, value: str) -> str:
    """What a rule puts in for a value: its marker, or a pseudonym whose number is still a symbol."""
    if not rule.is_unique:
        return literal(rule.literal)
    before, _, after = pseudonym_format(rule.category)
    head, tail = rule.literal.split(UNIQUE)
    return f"concat({literal(head + before + '0' + OPEN + rule.category + '=')}, hex({value}), {literal(CLOSE + '0' + after + tail)})"


def symbolic(text: str, rule: Rule, regex: str, values: str) -> str:
    """The text with every match replaced by a pseudonym whose number is still a symbol.

    ``values`` are the match values of the text.

    All but the number is final, so the rules that follow see what they would
    see with real numbers, without any lookup having happened yet.
    """
    return replace_each(text, regex, _prefix_reference(rule), f"transform({values}, v -> {_stand_in(rule, 'v')})")


def is_cut_at_once(rule: Rule) -> bool:
    """Whether a match's value is the match or groups of it, so that one pass of the pattern gives the values and the text."""
    return not rule.keeps_prefix or bool(rule.value_groups)


def cut_at_values(text: str, rule: Rule, regex: str) -> str:
    """A text without raw working characters in pieces, every second of them a match's value; one piece where nothing matches."""
    value = "".join(f"${g}" for g in rule.value_groups) if rule.keeps_prefix else "$0"
    return pieces(substitute(text, regex, _prefix_reference(rule) + CUT + value + CUT), CUT)


def cut_values(cut: str) -> str:
    return f"filter({cut}, (piece, at) -> at % 2 = 1)"


def cut_rewritten(cut: str, rule: Rule) -> str:
    """The text of these pieces as ``symbolic`` or ``masked`` gives it."""
    return f"array_join(transform({cut}, (piece, at) -> IF(at % 2 = 1, {_stand_in(rule, 'piece')}, piece)), '')"


def symbol(body: str) -> str:
    """The symbol with that body."""
    return f"concat({literal('0' + OPEN)}, {body}, {literal(CLOSE + '0')})"


def symbols(text: str) -> str:
    """The symbols in the text, in order, repeated as they occur."""
    return _group(text, SYMBOL, 1)


def has_symbols(text: str) -> str:
    return f"contains({text}, {literal(OPEN)})"


def numbered(text: str, numbers: str) -> str:
    """The text with its n-th symbol replaced by the n-th of ``numbers`` (strings)."""
    return replace_each(text, SYMBOL, "", numbers)


def _padded(number: str, width: int) -> str:
    text = f"cast({number} AS string)"
    return text if width < 2 else f"lpad({text}, greatest({width}, length({text})), '0')"


def number_text(category: str, number: str, categories) -> str:
    """A pseudonym's number as text, padded the way its category asks."""
    branches = " ".join(f"WHEN {literal(c)} THEN {_padded(number, pseudonym_format(c)[1])}" for c in categories)
    return f"CASE {category} {branches} END"


def pseudonym(category: str, number: str, categories) -> str:
    """The pseudonym itself: ``user001``, ``host001``, ``10.1.0.1``, ``entity001`` or ``NAME_001``."""
    branches = []
    for c in categories:
        before, width, after = pseudonym_format(c)
        branches.append(f"WHEN {literal(c)} THEN concat({literal(before)}, {_padded(number, width)}, {literal(after)})")
    return f"CASE {category} {' '.join(branches)} END"


# --- raw working characters ---------------------------------------------------

def protect(text: str) -> str:
    """Rewrite raw occurrences of the working characters, so that they cannot be mistaken.

    They become noncharacters, which keeps the length of what a rule measures.
    Only where a text holds those too, which valid text never does, all are escaped.
    """
    escaped = text
    for raw, stand_in in _SAFE.items():
        escaped = f"replace({escaped}, {literal(raw)}, {literal(ESCAPE + stand_in)})"
    swapped = f"translate({text}, {literal(_WORKING)}, {literal(_STAND_INS)})"
    return (f"CASE WHEN {any_contains(text, _STAND_INS)} THEN {escaped} "
            f"WHEN {any_contains(text, _WORKING)} THEN {swapped} ELSE {text} END")


def unprotect(text: str) -> str:
    plain = text
    for raw, stand_in in reversed(_SAFE.items()):
        plain = f"replace({plain}, {literal(ESCAPE + stand_in)}, {literal(raw)})"
    swapped = f"translate({text}, {literal(_STAND_INS)}, {literal(_WORKING)})"
    return (f"CASE WHEN contains({text}, {literal(ESCAPE)}) THEN {plain} "
            f"WHEN {any_contains(text, _STAND_INS)} THEN {swapped} ELSE {text} END")


# --- candidate lines --------------------------------------------------------

# Endings of the words that the context rules want before "=" or ":".
_WORD_ENDINGS = "ion|dbc|ord|swd|pwd|ret|key|ken|rer|ver|rce| id|uid|ser|ame|gin|ite|ook|ect"
_LAST_LETTERS = "nNcCdDtTyYrReEkKwWbB"


# The characters before which a line must be marked for a rule to match on it.
_ANCHORS = {3: "=:", 4: "=:", 5: "\\", 6: "-:", 7: "-:", 8: "@", 9: ".", 10: ".", 11: "=:", 12: "=:", 13: "=:", 14: "=:",
            15: "/", 16: "/", 17: "/", 18: "/", 19: "/", 20: "/", 21: "/", 22: "=:"}


def candidate_regex(catalogue: Catalogue) -> str:
    """A pattern found in every line on which some line rule has a match.

    It tests one character class and looks further only at the few characters
    of that class, so that a single scan of a whole text tells the lines that
    need the cascade from those that do not.  Each alternative is implied by one
    or more rules.  Rules added to the catalogue take part with their keywords.
    """
    pair = "[0-9A-Fa-f][0-9A-Fa-f]"
    address = f"{pair}[:-]{pair}[:-]{pair}"
    word = (rf"(?<=[\s\"{_LAST_LETTERS}\u017f\u212a][=:])(?:(?<=\s[=:])"
            rf"|(?<=(?iu:{_WORD_ENDINGS})\"?[=:])|(?<=(?iu:vw|wb)\"?[=:]))")
    scan = (
        rf"[@\\=:./-](?:(?={address}[:-])(?<=[:-]){address}[:-]{pair}[:-]{pair}|{word}|(?<=-)\d\d-\d\d\d\d"
        rf"|(?<=\.)(?:\d{{1,3}}\.\d{{1,3}}\.\d|(?iu:local|internal|corp|lan|intranet|private)\b)"
        rf"|(?<=/)(?:t|vizql/w|views|authoring)/|(?<=\\)\\|(?<=@))")
    added = sorted({k for r in catalogue.added_rules for k in r.keywords})
    scan += "".join(r"|(?iu:\Q" + k + r"\E)" for k in added)
    return ("(?U)" if catalogue.unicode else "") + scan


# --- lines ------------------------------------------------------------------

def normalise_line_ends(text: str) -> str:
    return f"replace({text}, '\\r\\n', '\\n')"


def split_lines(text: str) -> str:
    """Lines without their ends; a final line feed opens no further line."""
    return let("parts", pieces(text),
               "transform(IF(element_at(parts, -1) = '', slice(parts, 1, size(parts) - 1), parts), "
               "part -> regexp_replace(part, '\\r\\\\z', ''))")
