"""Added patterns that are repeated often: possessive where that is the same, else refused."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logveil.functions.patterns import UnsafePattern, safe_pattern
from logveil.functions.rules import Catalogue
from logveil.operators.redact import redact_documents

SAFE = {r"(?:ab|c)+z": r"(?:ab|c)++z", r"(?:a\d+,)*;": r"(?:a\d+,)*+;", r"x(?:[a-c]+-)+": r"x(?:[a-c]+-)++", r"(?:ab)+c": r"(?:ab)+c",
        r"(?:ab){2,5}": r"(?:ab){2,5}", r"[(ab|c)+]*": r"[(ab|c)+]*", r"\(ab|c\)+": r"\(ab|c\)+", r"(a|bc)+|(?:d|ef)*g": r"(a|bc)++|(?:d|ef)*+g",
        r"(?:ab|c)++z": r"(?:ab|c)++z", r"(?:a(?:b|cd)e?,)+z": r"(?:a(?:b|cd)e?,)++z", r"(?:ab|c){200,}": r"(?:ab|c){200,}+"}


@pytest.mark.parametrize("pattern", SAFE)
def test_safe(pattern):
    assert safe_pattern(pattern) == SAFE[pattern]


@pytest.mark.parametrize("pattern", [r"(?:ab|a)+b", r"(?:ab|c)+a", r"(?:\.[a-z]+)+x", r"(?:a|b)+\b", r"(?:a*)+b", r"((?:a|bc)+d)*", r"(?:a|bc)+?d",
                                     r"(?:(a)|b\1)+c"])
def test_refused(pattern):
    with pytest.raises(UnsafePattern):
        safe_pattern(pattern)
    with pytest.raises(ValueError):
        Catalogue.builtin().add("tag", pattern, "TAG", ["a"])


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([p for p in SAFE if SAFE[p] != p]), st.text("abcdefgxz0,;-", max_size=40))
def test_the_same_matches(pattern, text):
    assert [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(SAFE[pattern], text)]


def test_long_runs(spark):
    """60 000 characters of what each rule repeats, for all rules and an added one."""
    rules = Catalogue.builtin().add("tag", r"(?:ab|c)+z", "TAG", ["z"])
    runs = ["ab" * 30000 + "z", "abc" * 20000, "a." * 30000 + "local", "\\\\a" * 20000, "SELECT a\n" * 6000, "SELECT a\n" + "  b\n" * 15000, "a@" * 30000,
            "a.b-" * 15000 + "@x.org", "1-" * 30000, "12:" * 20000, "10.1." * 12000, "user=" * 12000, "/t/" * 20000, "/views/a/" * 7000,
            "password: " * 6000, '"token":"' * 7000, "jdbc:a://" + "x" * 60000, "-----BEGIN CERTIFICATE-----" + "x\n" * 30000, "Authorization: Basic " * 3000]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id int, text string").repartition(4)
    out = {r["doc_id"]: r["text"] for r in redact_documents(docs, "text", rules).collect()}
    assert len(out) == len(runs) and out[0] == "TAG" and out[1] == runs[1] and out[5] == "QUERY_REDACTED\n"
