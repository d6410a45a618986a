"""Logs redacted chunk by chunk against documents redacted as a whole."""

import random
from collections import Counter

import pytest

from logveil.functions.rules import Catalogue
from logveil.operators.redact import redact_documents
from logveil.operators.scan import redact_lines_scan

KEY, KEY_END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
CERT, CERT_END = "-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----"
LINES = [KEY, KEY_END, CERT, CERT_END, "a " + KEY, KEY_END + " tail x@y.com", KEY + "k" + KEY_END + " mid", "SELECT * FROM t", "  AND x = 1",
         "WHERE a=1", "plain user=bob login: eve", "", "mail a@b.com from 10.0.0.1", "INSERT INTO z", ")", CERT + " in " + CERT_END, "with q",
         "host a.local b.corp", "  indented", "token=abcdefghij0123456789x", CERT_END + KEY, KEY_END + CERT, "SELECT" + KEY, "  " + KEY,
         "c\x01d\x02 user=bob\x04", "two\nlines user=ann", CERT_END + "\nSELECT 1 from z"]


def log_of(seed, documents):
    rng = random.Random(seed)
    out = []
    for doc in range(documents):
        weights = [rng.choice([0.2, 1, 3]) for _ in LINES]
        out += [(doc, i + 1, line, f"row {i}") for i, line in enumerate(rng.choices(LINES, weights, k=rng.randint(1, 30)))]
    return out


def joined(rows):
    texts = {}
    for doc, _, line in sorted(rows, key=lambda r: r[:2]):
        texts.setdefault(doc, []).append(line)
    return {doc: "\n".join(lines) for doc, lines in texts.items()}


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_chunks_equal_documents(spark, chunk):
    rows = log_of(chunk, 300)
    lines = spark.createDataFrame(rows, "doc_id bigint, line_no bigint, line string, more string").repartition(7)
    done = redact_lines_scan(lines, "doc_id", "line_no", "line", lines_per_chunk=chunk)
    assert done.rows.columns == lines.columns
    found = done.rows.collect()
    assert all(r["more"] == f"row {r['line_no'] - 1}" for r in found)
    docs = spark.createDataFrame(list(joined([r[:3] for r in rows]).items()), "doc_id bigint, text string")
    whole = redact_documents(docs, "text").collect()
    by_lines = joined([r[:3] for r in found])
    wrong = [(r["doc_id"], by_lines.get(r["doc_id"]), r["text"]) for r in whole if by_lines.get(r["doc_id"]) != r["text"]]
    assert not wrong, f"{len(wrong)} wrong, such as {min(wrong, key=lambda w: len(w[2]))}"
    assert Counter((f["doc_id"], f["category"]) for f in done.findings.collect()) == \
        Counter((r["doc_id"], h["category"]) for r in whole for h in r["hits"])


def test_odd_lines(spark):
    schema = "line_no int, doc string, line string, hits int"
    rows = [(1, "a", "user=x", 1), (2, "a", None, 2), (2, "a", "user=y", 3), (2, "a", "user=y", 4), (None, "a", "user=z", 5), (1, None, "user=y", 6),
            (9000, "a", "user=x", 7), (9001, "a", KEY, 8), (20000, "a", "never closed", 9), (7, "b", "", 10), (8, "b", "x\ny\nuser=q", 11)]
    done = redact_lines_scan(spark.createDataFrame(rows, schema), "doc", "line_no", "line", catalogue=Catalogue.builtin())
    assert {r["hits"]: r["line"] for r in done.rows.collect()} == {
        1: "user=user002", 2: None, 3: "user=user003", 4: "user=user003", 5: "user=user001", 6: "user=user001", 7: "user=user002", 8: KEY,
        9: "never closed", 10: "", 11: "x\ny\nuser=user001"}
    none = redact_lines_scan(spark.createDataFrame([], schema), "doc", "line_no", "line")
    assert none.rows.count() == none.findings.count() == none.dictionary.count() == 0


def test_a_rule_over_lines_that_is_not_known_here(spark):
    rules = Catalogue.builtin().add("note", r"(?s)<<.*?>>", "NOTE", ["<<"], multiline=True)
    with pytest.raises(ValueError, match="spans lines"):
        redact_lines_scan(spark.createDataFrame([(1, 1, "x")], "d int, n int, l string"), "d", "n", "l", catalogue=rules)
