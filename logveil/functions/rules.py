"""The rule catalogue: what is looked for, under which gate, and what replaces it.

A rule is data.  Everything else in the package turns rules into Spark column
expressions, so adding a rule needs no code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

from logveil.functions.patterns import safe_pattern

UNIQUE = "{UNIQUE}"


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``pattern``        regular expression in Java syntax
    ``replacement``    literal text; ``${1}`` keeps the prefix, ``{UNIQUE}`` is a pseudonym
    ``keywords``       lower-case needles, one of which must occur (the gate)
    ``multiline``      run on the whole text before it is cut into lines
    ``ignore_case``    match letters of either case
    ``prefix_groups``  groups holding the kept prefix; one of them takes part in a match
    ``value_groups``   groups holding the value; empty means "the match minus its prefix"
    ``java_pattern``   equivalent form that the Java engine runs in linear time
    """

    rule_id: int
    category: str
    pattern: str
    replacement: str
    keywords: tuple[str, ...]
    multiline: bool = False
    ignore_case: bool = False
    prefix_groups: tuple[int, ...] = ()
    value_groups: tuple[int, ...] = ()
    java_pattern: str | None = None

    @property
    def is_unique(self) -> bool:
        return UNIQUE in self.replacement

    @property
    def keeps_prefix(self) -> bool:
        return "${1}" in self.replacement

    @property
    def literal(self) -> str:
        """The replacement without its prefix reference."""
        return self.replacement.replace("${1}", "")

    def regex(self, unicode: bool = False) -> str:
        """The pattern with its flags, for Spark's regexp functions.

        ``(?d)`` makes only a line feed end a line; ``(?iu)`` folds case beyond
        ASCII.  ``unicode`` widens ``\\d \\s \\b`` to all of Unicode.
        """
        flags = ("d" if "(?m)" in self.pattern else "") + ("iu" if self.ignore_case else "")
        flags += "U" if unicode else ""
        return (f"(?{flags})" if flags else "") + (self.java_pattern or self.pattern)


# --- Fixed values -----------------------------------------------------------
# Patterns, replacements and keyword gates define the results and are given
# data; their order is part of the contract (a rule reads what earlier ones left).

BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(0, "private_key",
         r"-----BEGIN (?:RSA |DSA |EC )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |DSA |EC )?PRIVATE KEY-----",
         "PRIVATE_KEY_REDACTED", ("-----begin",), multiline=True),
    Rule(1, "certificate",
         r"-----BEGIN CERTIFICATE-----[\s\S]*?-----END CERTIFICATE-----",
         "CERTIFICATE_REDACTED", ("-----begin certificate",), multiline=True),
    Rule(2, "sql_query",
         r"(?m)^[ \t]*(?:SELECT|INSERT\s+INTO|UPDATE|DELETE(?:\s+FROM)?|WITH)\b[^\n]*"
         r"(?:\n(?:[ \t]+\S[^\n]*|[)][^\n]*|(?:SELECT|FROM|WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|OFFSET"
         r"|UNION|INTERSECT|EXCEPT|AND|OR|SET|VALUES|INTO|CASE|WHEN|THEN|ELSE|END|JOIN|LEFT|RIGHT|INNER"
         r"|OUTER|CROSS|FULL|NATURAL|ON|AS)\b[^\n]*))*",
         "QUERY_REDACTED", ("select ", "insert into", "update ", "delete "),
         multiline=True, ignore_case=True),
    Rule(3, "auth_header", r"(Authorization\s*:\s*(?:Basic|Bearer|Digest)\s+)\S+",
         "${1}AUTH_TOKEN_REDACTED", ("authorization",), ignore_case=True, prefix_groups=(1,)),
    Rule(4, "db_connection", r'jdbc:[a-zA-Z0-9]+://[^;\s"]+', "DB_REDACTED", ("jdbc:",)),
    Rule(5, "unc_path",
         r"\\{2,}[a-zA-Z0-9_.-]+\\{1,}[a-zA-Z0-9_.$-]+(?:\\{1,}[a-zA-Z0-9_.$-]+)*",
         r"\\\\REDACTED_SERVER\\\\REDACTED_SHARE", ("\\\\",)),
    Rule(6, "ssn", r"\b\d{3}-\d{2}-\d{4}\b", "SSN_REDACTED", ("-",)),
    Rule(7, "mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "MAC_REDACTED", (":", "-")),
    Rule(8, "email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
         "{UNIQUE}@redacted.com", ("@",), ignore_case=True),
    Rule(9, "internal_ip",
         r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}"
         r"|172\.(?:1[6-9]|2[0-9]|3[01])\.\d{1,3}\.\d{1,3})\b",
         "{UNIQUE}", ("10.", "192.", "172.")),
    Rule(10, "hostname",
         r"\b(?:[a-zA-Z][a-zA-Z0-9-]*\.)+(?:local|internal|corp|lan|intranet|private)\b",
         "{UNIQUE}.redacted", (".local", ".internal", ".corp", ".lan", ".intranet", ".private"),
         ignore_case=True),
    Rule(11, "password",
         r"""((?:password|passwd|pwd|secret)\s*[=:]\s*)[^\s,;\\'"\}\]]+"""
         r"""|("(?:password|passwd|pwd|secret)"\s*:\s*")[^"]+""",
         "${1}PASSWORD_REDACTED", ("password", "passwd", "pwd", "secret"),
         ignore_case=True, prefix_groups=(1, 2)),
    Rule(12, "api_key",
         r"""((?:api[_-]?key|token|bearer)\s*[=:]\s*)[a-zA-Z0-9_-]{20,}"""
         r"""|("(?:api[_-]?key|token)"\s*:\s*")[^"]{20,}""",
         "${1}API_KEY_REDACTED", ("api_key", "api-key", "apikey", "token", "bearer"),
         ignore_case=True, prefix_groups=(1, 2)),
    Rule(13, "db_connection", r'\b(?:Server|Data Source|User ID|uid)\s*=\s*[^;\s"]+',
         "DB_REDACTED", ("server=", "data source=", "user id=", "uid="), ignore_case=True),
    Rule(14, "username",
         r"""((?:user(?:name)?|login)\s*[=:]\s*)([a-zA-Z0-9_@.-]+)"""
         r"""|("(?:user(?:name)?|login)"\s*:\s*")([^"]+)""",
         "${1}{UNIQUE}", ("user=", "user:", "username", "login", '"user"'),
         ignore_case=True, prefix_groups=(1, 3), value_groups=(2, 4)),
    Rule(15, "tableau_entity", r"(/t/)([^/]+)", "${1}{UNIQUE}", ("/t/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(16, "tableau_entity", r"(/vizql/w/)([^/]+)", "${1}{UNIQUE}", ("/vizql/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(17, "tableau_entity", r"(/vizql/w/[^/]+/v/)([^/]+)", "${1}{UNIQUE}", ("/vizql/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(18, "tableau_entity", r"(/views/)([^/]+)", "${1}{UNIQUE}", ("/views/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(19, "tableau_entity", r"(/views/[^/]+/)([^/?#\s]+)", "${1}{UNIQUE}", ("/views/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(20, "tableau_entity", r"(/authoring/)([^/]+)", "${1}{UNIQUE}", ("/authoring/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(21, "tableau_entity", r"(/authoring/[^/]+/)([^/?#\s]+)", "${1}{UNIQUE}", ("/authoring/",),
         prefix_groups=(1,), value_groups=(2,)),
    Rule(22, "tableau_entity",
         r"""((?:site|workbook|datasource|project|vw|wb)\s*[=:]\s*)([^\s,;\\'"\}\]]+)"""
         r"""|("(?:site|workbook|datasource|project|vw|wb)"\s*:\s*")([^"]+)""",
         "${1}{UNIQUE}",
         ("site=", "site:", "workbook", "datasource", "project",
          '"site"', '"vw"', '"wb"', "vw=", "vw:", "wb=", "wb:"),
         ignore_case=True, prefix_groups=(1, 3), value_groups=(2, 4)),
)

# Pseudonym shape per category: text before the number, zero-padded width, text after.
PSEUDONYM_FORMATS: dict[str, tuple[str, int, str]] = {
    "username": ("user", 3, ""),
    "email": ("user", 3, ""),
    "hostname": ("host", 3, ""),
    "internal_ip": ("10.", 1, ".0.1"),
    "tableau_entity": ("entity", 3, ""),
}
# --- End of fixed values ----------------------------------------------------

# Forms for a backtracking engine, equal in what they match:
#  2  a possessive tail, since a plain one recurses once per continuation line;
#  5  the same for the parts of a path;
#  8  an address can only start where its run of characters starts, or where the
#     previous match ended, so the other starts need not be tried;
# 10  labels as one run of characters in which a letter follows every dot, since
#     the plain form recurses once per label.
_JAVA_FORMS = {
    2: lambda p: p[:-1] + "*+",
    5: lambda p: p[:-1] + "*+",
    8: lambda p: r"(?:\G|(?<![a-zA-Z0-9._%+-]))" + p.replace("]+@", "]++@", 1),
    10: lambda p: p.replace(r"(?:[a-zA-Z][a-zA-Z0-9-]*\.)+", r"(?=[a-zA-Z])(?:(?!\.(?![a-zA-Z]))[a-zA-Z0-9.-])+\."),
}


def is_builtin(rule: Rule) -> bool:
    """Whether a rule is one of the given ones, unchanged; only of those the package knows more than they say."""
    return rule.rule_id < len(BUILTIN_RULES) and replace(rule, java_pattern=None) == BUILTIN_RULES[rule.rule_id]


def pseudonym_format(category: str) -> tuple[str, int, str]:
    """Shape of a category's pseudonyms; categories of added rules get ``NAME_001``."""
    return PSEUDONYM_FORMATS.get(category, (category.upper() + "_", 3, ""))


class Catalogue:
    """An ordered, extensible list of rules."""

    def __init__(self, rules: Iterable[Rule], unicode: bool = False):
        self.rules = tuple(sorted(rules, key=lambda r: r.rule_id))
        self.unicode = unicode
        if len({r.rule_id for r in self.rules}) != len(self.rules):
            raise ValueError("rule ids must be distinct")

    @classmethod
    def builtin(cls, unicode: bool = False) -> Catalogue:
        rules = (replace(r, java_pattern=_JAVA_FORMS[r.rule_id](r.pattern))
                 if r.rule_id in _JAVA_FORMS else r for r in BUILTIN_RULES)
        return cls(rules, unicode)

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def __getitem__(self, rule_id: int) -> Rule:
        return next(r for r in self.rules if r.rule_id == rule_id)

    def add(self, category: str, pattern: str, replacement: str, keywords: Iterable[str],
            **options) -> Catalogue:
        """A new catalogue with one more rule, run after all present ones.

        A group that is repeated often is made possessive where that matches the
        same, else the pattern is refused: it could overflow the stack.
        """
        if "${1}" in replacement:
            options.setdefault("prefix_groups", (1,))
        taken = [r.rule_id for r in (*BUILTIN_RULES, *self.rules)]
        rule = Rule(max(taken) + 1, category, pattern, replacement,
                    tuple(k.lower() for k in keywords), **options)
        if rule.java_pattern is None and (safe := safe_pattern(pattern, rule.ignore_case)) != pattern:
            rule = replace(rule, java_pattern=safe)
        if not rule.keywords:
            raise ValueError("a rule needs at least one keyword")
        if rule.multiline and rule.is_unique:
            raise ValueError("a multiline rule masks; it cannot give pseudonyms")
        return Catalogue((*self.rules, rule), self.unicode)

    def select(self, categories: Iterable[str] | None = None,
               rule_ids: Iterable[int] | None = None) -> Catalogue:
        """The rules of the given categories and ids only."""
        wanted_categories = None if categories is None else set(categories)
        wanted_ids = None if rule_ids is None else set(rule_ids)
        return Catalogue((r for r in self.rules
                          if (wanted_categories is None or r.category in wanted_categories)
                          and (wanted_ids is None or r.rule_id in wanted_ids)), self.unicode)

    def regex(self, rule: Rule) -> str:
        return rule.regex(self.unicode)

    @property
    def text_rules(self) -> list[Rule]:
        """Rules for the whole text."""
        return [r for r in self.rules if r.multiline]

    @property
    def line_rules(self) -> list[Rule]:
        return [r for r in self.rules if not r.multiline]

    @property
    def added_rules(self) -> list[Rule]:
        """Rules that are not built in, or are changed."""
        return [r for r in self.rules if not is_builtin(r)]

    def stages(self) -> list[list[Rule]]:
        """Line rules in groups inside which pseudonym numbers may stay symbolic.

        A new group starts where a rule could notice how many digits a number
        has: after the network rules (a later rule wants 20 characters or more)
        and, since nothing is known of their patterns, at every added rule.
        """
        key = lambda r: (0 if r.rule_id <= 10 else 1) if is_builtin(r) else f"own {r.rule_id}"
        return [list(rules) for _, rules in groupby(self.line_rules, key)]

    @property
    def spread_categories(self) -> set[str]:
        """Categories that give pseudonyms in more than one stage; their numbers go on from stage to stage."""
        stages = [{r.category for r in rules if r.is_unique} for rules in self.stages()]
        return {c for i, names in enumerate(stages) for c in names if any(c in other for other in stages[:i])}

    @property
    def unique_categories(self) -> list[str]:
        return sorted({r.category for r in self.rules if r.is_unique})

    @property
    def categories(self) -> list[str]:
        return sorted({r.category for r in self.rules})

    @property
    def keywords(self) -> list[str]:
        return sorted({k for r in self.rules for k in r.keywords})

    def dataframe(self, spark):
        """The catalogue as a table."""
        rows = [(r.rule_id, r.category, r.pattern, r.replacement, list(r.keywords),
                 r.multiline, r.ignore_case, r.is_unique) for r in self.rules]
        return spark.createDataFrame(
            rows, "rule int, category string, pattern string, replacement string, "
                  "keywords array<string>, multiline boolean, ignore_case boolean, is_unique boolean")
