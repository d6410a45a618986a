"""The log-structured dictionary: few runs, few partitions read, batches that can be run again."""

import os

from logveil.streaming.dictionary import ENTRIES, ENTRIES_COLUMNS, DictionaryLog


def entry(i):
    category = "email" if i % 3 else "username"
    return ("corpus", category, f"{category}={i:04x}", str(i), i + 1, 1, f"user{i + 1:03d}", f"{i + 1:03d}")


def test_batches(spark, tmp_path):
    log = DictionaryLog(str(tmp_path), fanout=3, part=20)
    for batch in range(14):
        rows = spark.createDataFrame([entry(i) for i in range(30 * batch, 30 * batch + 30)], ENTRIES)
        for _ in range(2 if batch % 4 == 3 else 1):
            log.add(rows, batch)
    known = log.before(spark, 14)
    # 14 = 112 in base 3: one run of 9 batches, one of 3, two of one
    assert [(level, size) for level, _, _, size in known.runs] == [(0, 30), (0, 30), (1, 90), (2, 270)]
    assert sorted(tuple(r) for r in known.all().collect()) == sorted(entry(i) for i in range(420))
    assert {r["category"]: r["last"] for r in known.last.collect()} == {"email": 420, "username": 418}
    # what was merged two batches ago is gone, what a batch run again needs is not
    assert {r[1] for r in log.before(spark, 13).runs} | {r[1] for r in known.runs} == set(os.listdir(tmp_path / "runs"))

    keys = [entry(i)[:1] + entry(i)[2:3] for i in (5, 200, 419)] + [("corpus", "email=none"), ("other", "email=0005")]
    found = known.among(spark.createDataFrame(keys, "_scope string, body string"))
    assert found.columns == ENTRIES_COLUMNS and sorted(tuple(r) for r in found.collect()) == sorted(entry(i) for i in (5, 200, 419))
    # a run of 270 entries has 16 partitions, and no more of them are read than there are values
    assert max(n for _, n in known.read) <= 5
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_prefix" in plan
    assert known.among(spark.createDataFrame([], "_scope string, body string")).count() == 0


def test_before_the_first_batch(spark, tmp_path):
    known = DictionaryLog(str(tmp_path)).before(spark, 0)
    assert known.all().count() == known.last.count() == known.among(spark.createDataFrame([("corpus", "x")], "_scope string, body string")).count() == 0
