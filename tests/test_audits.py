"""Leaks found by anchors against every value tried on every line."""

import random
import re

from logveil.operators.audits import leaks


def test_leaks(spark):
    rng = random.Random(2)
    words = ["ann", "bob", "x", "-", "@", "Émile", "a.b", "10.0.0.1", "host", " ", "bobby", "[q]", "\\E"]
    lines = [(i, "".join(rng.choice(words) + rng.choice(["", " ", "=", "_"]) for _ in range(rng.randint(0, 8)))) for i in range(400)]
    values = [(f"c{i % 3}", "".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(80)] + [("c0", "ann"), ("c0", "---")]
    found = leaks(spark.createDataFrame(values, "category string, original string"), spark.createDataFrame(lines, "id int, line string"), ["id"], "line")
    word = r"[^\W]"
    want = set()
    for category, value in set(values):
        if not re.search(word, value):
            continue
        pattern = (f"(?<!{word})" if re.match(word, value) else "") + re.escape(value) + (f"(?!{word})" if re.search(word + r"\Z", value) else "")
        want |= {(i, category, value) for i, line in lines if re.search(pattern, line)}
    assert len(want) > 100 and {tuple(r) for r in found.collect()} == want
