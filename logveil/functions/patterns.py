"""Added patterns made safe for a backtracking engine.

Java repeats a group whose length varies, or that has alternatives, by calling
itself once for each repetition, so a text of some tens of thousands of them
ends the JVM.  A possessive repetition does not: it never gives back what it took.
It matches the same where giving back could never help, which the first
characters of the parts tell: no alternative, no optional part and nothing after
the repetition may begin as what it could be mistaken for.  Where that holds the
repetition is made possessive; where it cannot be told the pattern is refused.
"""

from __future__ import annotations

import re
from re import _compiler as compiler
from re import _constants as K  # the names of the parts of a parsed pattern
from re import _parser as parser

#: Characters by which sets are compared: two blocks of letters with all of ASCII, and one each of other scripts and planes.
_SAMPLE = [chr(c) for c in range(0x250)] + list("Жя٣अ一\u2003\u2028") + ["\U0001F642"]
#: Repetitions up to so many times are left as they are.
SHORT = 100
_QUANTIFIER = re.compile(r"(?:[*+]|\{(\d+)(?:(,)(\d*))?\})([+?]?)")


class UnsafePattern(ValueError):
    """A repeated group that may overflow the stack."""


def _repetitions(pattern: str) -> list[tuple[int, int, int, bool]]:
    """``(start, end of the group, end of its quantifier, at top level)`` of groups repeated often and not possessively."""
    found, open_, at = [], [], 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith(r"\Q", at):
            end = pattern.find(r"\E", at)
            at = len(pattern) if end < 0 else end + 2
            continue
        if c == "\\":
            at += 2
            continue
        if c == "[":
            depth, at = 1, at + (2 if pattern.startswith("[^", at) else 1)
            at += pattern.startswith("]", at)
            while depth and at < len(pattern):
                depth += {"[": 1, "]": -1}.get(pattern[at], 0)
                at += 2 if pattern[at] == "\\" else 1
            continue
        if c == "(":
            open_.append(at)
        elif c == ")" and open_:
            start, end = open_.pop(), at + 1
            quantifier = _QUANTIFIER.match(pattern, end)
            if quantifier and quantifier[4] != "+":
                most = quantifier[3] if quantifier[2] else quantifier[1]
                if not (most and int(most) <= SHORT):
                    found.append((start, end, quantifier.end(), not open_))
        at += 1
    return found


def _is_set(node) -> bool:
    return node[0] in (K.LITERAL, K.NOT_LITERAL, K.ANY, K.IN)


def _characters(node, flags: int) -> frozenset[str]:
    """The sample characters that a node for one character matches."""
    state = parser.State()
    state.flags = flags
    sub = parser.SubPattern(state, [node])
    one = compiler.compile(sub, flags)
    return frozenset(c for c in _SAMPLE if one.fullmatch(c))


def _first(nodes, flags: int) -> tuple[frozenset[str], bool]:
    """The characters with which a match of ``nodes`` can begin, and whether it can be empty."""
    out: frozenset[str] = frozenset()
    for node in nodes:
        kind, value = node
        if _is_set(node):
            return out | _characters(node, flags), False
        if kind is K.SUBPATTERN:
            found, empty = _first(value[3], flags)
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            found, empty = _first(value[2], flags)
            empty = empty or value[0] == 0
        elif kind is K.BRANCH:
            each = [_first(branch, flags) for branch in value[1]]
            found, empty = frozenset().union(*(f for f, _ in each)), any(e for _, e in each)
        else:
            raise UnsafePattern
        out |= found
        if not empty:
            return out, False
    return out, True


def _decided(nodes, follow: frozenset[str], flags: int) -> bool:
    """Whether every choice in ``nodes`` is made by the next character."""
    for i, node in enumerate(nodes):
        kind, value = node
        after, empty = _first(nodes[i + 1:], flags)
        after = after | follow if empty else after
        if _is_set(node):
            continue
        if kind is K.SUBPATTERN:
            if not _decided(list(value[3]), after, flags):
                return False
        elif kind in (K.MAX_REPEAT, K.POSSESSIVE_REPEAT):
            own, nothing = _first(value[2], flags)
            if nothing or value[0] != value[1] and own & after or not _decided(list(value[2]), own | after, flags):
                return False
        elif kind is K.BRANCH:
            firsts = [_first(branch, flags) for branch in value[1]]
            if any(e for _, e in firsts) or sum(len(f) for f, _ in firsts) != len(frozenset().union(*(f for f, _ in firsts))):
                return False
            if not all(_decided(list(branch), after, flags) for branch in value[1]):
                return False
        else:
            return False
    return True


def _fixed(nodes) -> bool:
    """Whether all matches take the same steps, which Java repeats in a loop of its own."""
    return all(_is_set(n) or n[0] is K.SUBPATTERN and _fixed(n[1][3]) or n[0] in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT)
               and n[1][0] == n[1][1] and _fixed(n[1][2]) for n in nodes)


def _alternative(rest: str) -> str:
    """``rest`` up to the next alternative at its own level."""
    depth = at = 0
    while at < len(rest):
        if rest[at] == "\\":
            at += 1
        elif rest[at] == "[":
            at = rest.index("]", at + 1 + rest.startswith("[^", at) + 1)
        elif rest[at] in "()":
            depth += 1 if rest[at] == "(" else -1
        elif rest[at] == "|" and not depth:
            return rest[:at]
        at += 1
    return rest


def safe_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern that matches the same and needs no stack for long texts; ``UnsafePattern`` if there is none to be found."""
    flags = re.IGNORECASE if ignore_case else 0
    marks = []
    for start, end, after, top in _repetitions(pattern):
        try:
            body = list(parser.parse(pattern[start:end], flags))
            # the parser takes (?:a|b) for one set, but Java does not
            if "|" not in pattern[start:end] and _fixed(body):
                continue
            rest = list(parser.parse(_alternative(pattern[after:]), flags))
            own, nothing = _first(body, flags)
            follow, empty = _first(rest, flags)
            # what can match nothing after it never makes the repetition give back
            exact = top and not nothing and pattern[after - 1] != "?" and (empty or not own & follow) and _decided(
                body, own | follow, flags)
        except (UnsafePattern, re.error, ValueError, IndexError):
            exact = False
        if not exact:
            raise UnsafePattern(f"{pattern[start:after]!r} in {pattern!r} could overflow the stack on a long text; "
                                "repeat it possessively (++ or *+), or a set of characters instead of a group")
        marks.append(after)
    for at in sorted(marks, reverse=True):
        pattern = pattern[:at] + "+" + pattern[at:]
    return pattern
