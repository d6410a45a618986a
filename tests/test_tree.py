"""Trees of files: the sink, the job over a whole tree, arriving files, and logs in several encodings."""

import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logveil.operators.tree import redact_tree
from logveil.sources.files import scan_encoded_lines, scan_files
from logveil.sources.tree import write_tree
from logveil.streaming.files import FileRouter

FILES = {"a/x.log": b"user=bob\r\nmail a@b.com\n", "a/b/latin.txt": "café user=ann".encode("latin-1"), "pic.png": bytes(range(256)),
         "bad.json": b"ab\x00cd", "cut.log": b"\xff\xfe\x00", "empty.log": b"", "wide.xml": "﻿user=eve 一".encode("utf-16-le"),
         "_h/.profile.log": b"login: zed", ".hidden": b"\x01", "a/com1.log": b"token=abcdefghij0123456789x"}


def make(root):
    for path, content in FILES.items():
        place = Path(root) / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)
    return str(root)


def tree_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.mark.parametrize("scope", ["doc", "corpus"])
def test_whole_tree(spark, tmp_path, scope):
    run = redact_tree(spark, make(tmp_path / "in"), str(tmp_path / "out"), scope=scope)
    out = tree_of(tmp_path / "out")
    names = {k: v.split(b"user=")[1][:7] for k, v in out.items() if b"user=" in v}
    assert set(out) == {"a/x.log", "a/b/latin.txt", "pic.png", "empty.log", "wide.xml", "a/_com1.log", "_h/.profile.log", ".hidden"}
    assert out["pic.png"] == FILES["pic.png"] and out["empty.log"] == b"" and out["a/_com1.log"] == b"token=API_KEY_REDACTED"
    assert out["a/b/latin.txt"].decode().startswith("café user=user00") and out["wide.xml"].decode().endswith(" 一")
    assert len(set(names.values())) == (1 if scope == "doc" else 3)
    results = {r["path"]: r for r in run.files.collect()}
    assert {p: r["outcome"] for p, r in results.items()} == {
        p: {"pic.png": "copied", ".hidden": "copied", "bad.json": "quarantined", "cut.log": "quarantined"}.get(p, "redacted") for p in FILES}
    assert results["a/x.log"]["counts"] == {"email": 1, "username": 1} and results["bad.json"]["error"] == "looks binary"
    assert all(r["size"] == len(FILES[p]) and r["written"] == len(out.get(r["target"], b"")) for p, r in results.items())
    phases = {r["phase"]: r for r in run.phases.collect()}
    assert phases["redact"]["bytes_in"] == sum(r["size"] for r in results.values() if r["outcome"] == "redacted")
    assert phases["write"]["bytes_out"] == sum(r["written"] for r in results.values() if r["outcome"] == "redacted")
    assert phases["copy"]["files"] == 2 and phases["quarantine"]["files"] == 2 and all(r["seconds"] > 0 for r in phases.values())


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.expr("IF(id = 33, '../x', concat('f', id))").alias("path"), F.lit("x").alias("content")).repartition(4)
    with pytest.raises(PySparkException):
        write_tree(spark, rows, str(tmp_path / "out"))
    assert tree_of(tmp_path / "out") == {} and not any(n.startswith("_staging") for n in os.listdir(tmp_path / "out"))


@pytest.mark.parametrize("paths", [["a", "a"], ["../a"], ["/a"], ["a//b"]])
def test_paths_that_cannot_be_written(spark, tmp_path, paths):
    with pytest.raises(PySparkException):
        write_tree(spark, spark.createDataFrame([(p, b"x") for p in paths], "path string, content binary"), str(tmp_path / "out"))
    assert tree_of(tmp_path) == {}


def test_a_batch_of_files_run_twice(spark, tmp_path):
    files, router = scan_files(spark, make(tmp_path / "in")), FileRouter(str(tmp_path / "out"))
    for batch in (0, 1, 1):
        router(files.filter(F.col("path").startswith("a/") == (batch == 0)), batch)
    read = lambda outcome: sorted(r["path"] for r in spark.read.parquet(f"{tmp_path}/out/{outcome}").select("path").collect())
    assert read("quarantined") == ["bad.json", "cut.log"] and read("copied") == ["pic.png"]
    assert read("redacted") == ["a/b/latin.txt", "a/com1.log", "a/x.log", "wide.xml"]


def test_encodings_of_logs_cut_anywhere(spark, tmp_path):
    """Splits of 64 bytes cut characters, and letters whose bytes look like a line feed stand side by side."""
    lines = {kind: [f"{i} éè " + "x" * (i % 30) + "\r" * (i % 2) for i in range(200)] for kind in ("utf-8", "latin-1")}
    lines["utf-16-le"] = [f"{i} ਅ一ਅĀ" + "਀" * (i % 4) + "y" * (i % 7) for i in range(200)]
    lines["utf-16-be"] = [f"{i} 一ਅĀ਀" + "\u000bਊ" * (i % 3) for i in range(200)]
    (tmp_path / "in").mkdir()
    for kind, rows in lines.items():
        (tmp_path / "in" / f"{kind}.log").write_bytes(("﻿" * kind.startswith("utf-16") + "\n".join(rows) + "\n").encode(kind))
    (tmp_path / "in" / "empty.log").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        found = scan_encoded_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in sorted(found, key=lambda r: r["line_no"]):
        by_file.setdefault(r["path"].removesuffix(".log"), []).append((r["line_no"], r["line"]))
    assert by_file == {k: [(i + 1, row.removesuffix("\r")) for i, row in enumerate(v)] for k, v in lines.items()}
