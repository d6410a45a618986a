"""File scanning, classes, decoding, paths and report formats."""

import pytest
from pyspark.sql import functions as F

from logveil.functions import files as P
from logveil.operators import reports
from logveil.sources import files as sources
from logveil.sources.staging import release, staged, staging_dir
from logveil.streaming.incremental import quarantine


def values(spark, kind, given, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, v {kind}")
    return [r.x for r in df.select("i", F.expr(expression).alias("x")).orderBy("i").collect()]


def test_durations(spark):
    given = [5.5, 0.0, 59.94, 90.0, 3725.0, 60.0, 3600.0, 119.7]
    assert values(spark, "double", given, P.duration("v")) == \
        ["5.5s", "0.0s", "59.9s", "1m 30s", "1h 2m 5s", "1m 0s", "1h 0m 0s", "1m 60s"]


def test_binary_sniff(spark):
    given = [bytearray(b) for b in (b"", b"plain text\n", b"a\x00b", b"\x01" * 20 + b"a" * 80, b"\x01" * 10 + b"a" * 90,
                                    b"a" * 8192 + b"\x00", "é".encode("latin-1") * 20, bytes(range(256)) * 100)]
    assert values(spark, "binary", given, P.looks_binary("v")) == [False, False, True, True, False, False, False, True]


def test_decoding(spark):
    given = [bytearray(b) for b in ("naïve".encode(), "user=admin caféx".encode("latin-1"), "höst".encode("utf-16"),
                                    b"\xfe\xff" + "höst".encode("utf-16-be"), b"")]
    assert values(spark, "binary", given, P.decoded("v")) == ["naïve", "user=admin caféx", "höst", "höst", ""]


def test_paths(spark):
    given = ["logs/NUL.txt", "con/a.log", "a/com1", "a/com10", "a/lpt9.tar.gz", ".profile", "x/aux.TXT"]
    assert values(spark, "string", given, P.sanitized_path("v")) == \
        ["logs/_NUL.txt", "_con/a.log", "a/_com1", "a/com10", "a/lpt9.tar.gz", ".profile", "x/_aux.TXT"]
    assert values(spark, "string", ["a/logs.zip", "logs", "a.b/c"], P.output_root("v")) == \
        ["a/logs_anonymized", "logs_anonymized", "a.b/c_anonymized"]
    assert values(spark, "string", ["a.LOG", "b.bin", "x/.log", "y.htm", "z"], P.file_class("v")) == \
        ["text", "binary", "binary", "text", "binary"]


def test_scan_classify_and_decode(spark, tmp_path):
    (tmp_path / "logs" / "deep").mkdir(parents=True)
    (tmp_path / "logs" / "a.log").write_bytes(b"user=bob\n")
    (tmp_path / "logs" / "deep" / "b.txt").write_bytes("pwd=ü".encode("latin-1"))
    (tmp_path / "logs" / "c.log").write_bytes(b"\x00\x01\x02")
    (tmp_path / "logs" / "late.log").write_bytes(b"user=bob\n" * 2000 + b"\x00")
    (tmp_path / "logs" / "wide.log").write_bytes("user=zoë\n".encode("utf-16"))
    (tmp_path / "data.dat").write_bytes(bytes(range(256)) * 100)
    found = sources.scan_files(spark, str(tmp_path))
    assert {r.path: r.size for r in found.select("path", "size").collect()} == \
        {"logs/a.log": 9, "logs/deep/b.txt": 5, "logs/c.log": 3, "logs/late.log": 18001, "logs/wide.log": 20, "data.dat": 25600}
    assert {r.path: r.text for r in sources.text_files(found).collect()} == \
        {"logs/a.log": "user=bob\n", "logs/deep/b.txt": "pwd=ü", "logs/wide.log": "user=zoë\n"}
    assert {r.path for r in sources.untouched_files(found).select("path").collect()} == {"data.dat"}
    assert {r.path: r.error for r in sources.rejected_files(found).collect()} == {"logs/c.log": "looks binary", "logs/late.log": "looks binary"}
    rollup = {(r["class"], r.size_class): r.files for r in reports.manifest_rollup(sources.manifest(found)).collect()}
    assert rollup[("all", "all")] == 6 and rollup[("text", "all")] == 5


@pytest.mark.parametrize("split", ["64m", "1000"])
def test_scan_lines_numbers_lines_across_splits(spark, tmp_path, split):
    want = {}
    for f in range(3):
        lines = [f"{f} line {i} " + "x" * (i % 40) for i in range(400 * f + 7)]
        (tmp_path / f"f{f}.log").write_text("\n".join(lines) + "\n")
        want.update({(f"f{f}.log", i + 1): line for i, line in enumerate(lines)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = {(r.path, r.line_no): r.line for r in sources.scan_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == want


def test_write_lines_keeps_order(spark, tmp_path):
    lines = spark.range(5000).select(F.lit("a/NUL.log").alias("path"), (F.col("id") + 1).alias("line_no"),
                                     F.concat(F.lit("l"), "id").alias("line")).repartition(7)
    sources.write_lines(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").rglob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.split() == [f"l{i}" for i in range(5000)]


def test_quarantine(spark):
    given = [("ok", bytearray(b"pwd=x")), ("odd", bytearray(b"\xff\xfea")), ("lone", bytearray(b"\xff\xfe\x00\xd8a\x00")),
             ("utf16", bytearray("hé".encode("utf-16"))), ("none", None)]
    files = spark.createDataFrame([(p, len(c or b""), c) for p, c in given], "path string, size bigint, content binary")
    good, bad = quarantine(files)
    assert {r.path: r.text for r in good.collect()} == {"ok": "pwd=x", "utf16": "hé"}
    assert {r.path: r.error for r in bad.collect()} == {"odd": "invalid UTF-16", "lone": "invalid UTF-16", "none": "no content"}


def test_long_documents_stay_whole(spark):
    lines = spark.range(70_000).select(F.lit(1).alias("doc"), (F.col("id") + 1).alias("n"), F.col("id").cast("string").alias("line"))
    assert [r.text for r in sources.join_lines(lines, "doc", "n", "line").collect()] == ["\n".join(map(str, range(70_000)))]
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")], "doc int, n int, line string")
    assert [r.text for r in sources.join_lines(lines, "doc", "n", "line").collect()] == ["a\n\nc"]


def test_only_line_feeds_end_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\rtwo\r\nthree\r\r\nfour")
    assert {r.line_no: r.line for r in sources.scan_lines(spark, str(tmp_path)).collect()} == {1: "one\rtwo", 2: "three\r", 3: "four"}


def test_staged_tables_are_released(spark):
    df = staged(spark.range(3).toDF("x"), "probe")
    assert df.count() == 3
    path = df.inputFiles()[0]
    release(spark)
    from pathlib import Path
    assert not Path(path.removeprefix("file://")).exists() and staging_dir(spark)
