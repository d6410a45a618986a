"""Blocks found over buckets of lines against the regular expressions over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from logveil.functions.rules import Catalogue
from logveil.operators import blocks
from logveil.operators.redact import redact_documents
from logveil.sources.files import join_lines
from tests.model import BLOCK_LINES


@pytest.mark.parametrize("bucket", [3, 65536])
def test_islands_equal_regular_expressions(spark, monkeypatch, bucket):
    monkeypatch.setattr(blocks, "LINES_PER_BUCKET", bucket)
    rng = random.Random(bucket)
    # A line that closes one PEM block and opens another is the stated exception.
    choices = [line for line in BLOCK_LINES if "x-----END" not in line]
    texts = [(i, "\n".join(rng.choice(choices) for _ in range(rng.randint(1, 25)))) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(8)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")) \
        .withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))
    catalogue = Catalogue.builtin()
    done = blocks.collapse_blocks(lines, "doc_id", "line_no", "line", catalogue)
    by_lines = {r.doc_id: r.text for r in join_lines(done, "doc_id", "line_no", "line").collect()}
    only = catalogue.select(rule_ids=[0, 1, 2])
    by_text = {r.doc_id: r.text for r in redact_documents(docs, "text", only).collect()}
    wrong = [(texts[i][1], by_lines.get(i), by_text[i]) for i in by_text if by_lines.get(i) != by_text[i]]
    assert not wrong, f"{len(wrong)} wrong, such as {min(wrong, key=lambda w: len(w[0]))}"
