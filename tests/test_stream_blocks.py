"""Blocks cut by the edges of batches."""

import random

import pytest

from logveil.functions.rules import Catalogue
from logveil.operators.redact import redact_documents
from logveil.streaming.blocks import BlockRedactor
from tests.test_scan import CERT, CERT_END, KEY, KEY_END, joined, log_of

SCHEMA = "doc_id bigint, line_no bigint, line string"
DOCUMENT = ["first", "a " + KEY, "k1", "k2 " + CERT, KEY_END + " tail " + CERT, "c1", CERT_END, "SELECT a from t", "  WHERE x", "AND y", "user=bob", ""]


def run(spark, root, batches, catalogue, again=()):
    redactor = BlockRedactor("doc_id", "line_no", "line", f"{root}/out", f"{root}/dictionary", f"{root}/carry", catalogue=catalogue)
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for k, frame in enumerate(frames):
        redactor(frame, k)
        if k in again:
            redactor(frame, k)
    redactor.flush(spark, len(batches) - 1, frames[0].schema)
    return joined([tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{root}/out/batch=*").collect()])


def whole(spark, rows, catalogue):
    docs = spark.createDataFrame(list(joined(rows).items()), "doc_id bigint, text string")
    return {r["doc_id"]: r["text"] for r in redact_documents(docs, "text", catalogue).collect()}


def test_every_edge(spark, tmp_path):
    """One document for each place to cut it, all cut at once; the second batch is run twice."""
    rules = Catalogue.builtin()
    rows = [(cut, i + 1, line) for cut in range(len(DOCUMENT) + 1) for i, line in enumerate(DOCUMENT)]
    batches = [[r for r in rows if r[1] <= r[0]], [r for r in rows if r[1] > r[0]]]
    static = rules.select(rule_ids=[r.rule_id for r in rules if not r.is_unique])
    assert run(spark, tmp_path, batches, static, again={1}) == whole(spark, rows, static)


@pytest.mark.parametrize("seed", [1])
def test_random_edges(spark, tmp_path, seed):
    rng = random.Random(seed)
    static = Catalogue.builtin().select(categories=["private_key", "certificate", "password", "ssn"])
    rows = [r[:3] for r in log_of(seed, 150) if "\n" not in r[2]]
    edges = {doc: sorted(rng.choices(range(31), k=3)) for doc in range(150)}
    batches = [[r for r in rows if sum(r[1] > e for e in edges[r[0]]) == k] for k in range(4)]
    assert run(spark, tmp_path, batches, static) == whole(spark, rows, static)


def test_names_hold_from_batch_to_batch(spark, tmp_path):
    rows = [(1, 1, "user=ann"), (1, 2, KEY), (1, 3, "x"), (1, 4, KEY_END + " user=bob"), (1, 5, "user=ann"), (1, 6, KEY), (1, 7, "open user=cy")]
    out = run(spark, tmp_path, [rows[:2], rows[2:3], rows[3:]], Catalogue.builtin(), again={0, 2})
    assert out == {1: "user=user001\nPRIVATE_KEY_REDACTED user=user002\nuser=user001\n" + KEY + "\nopen user=user003"}
