"""Inputs and passes that grow with the tables: tasks, batches and listings."""

import pickle
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logveil.functions.rules import Catalogue
from logveil.operators import cascade, reports
from logveil.operators.redact import redact_documents
from logveil.plans import queries as Q
from logveil.sources.files import scan_encoded_lines, scan_files
from logveil.sources.tree import READ, FileTreeWriter
from logveil.streaming import blocks
from logveil.streaming.files import files_together
from tests.model import Model


def test_small_files_are_opened_once(spark, tmp_path):
    contents = {"u8": "﻿é\r\n\nb\r".encode(), "latin": "é\nb\n".encode("latin-1"), "le": "﻿ਅ一ਅĀ\r\n\nx\n".encode("utf-16-le"),
                "be": "﻿一ਅ\n".encode("utf-16-be"), "mark": b"\xff\xfe", "one": b"\n", "none": b"", "cr": b"a\rb\r\r\n"}
    (tmp_path / "in").mkdir()
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)

    def lines():
        found = scan_encoded_lines(spark, str(tmp_path / "in"))
        return found, sorted(tuple(r) for r in found.select("path", "line_no", "line").collect())
    whole, rows = lines()
    assert "Join" not in whole._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        split, same = lines()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Join" in split._jdf.queryExecution().toString()
    of = lambda name: [r[2] for r in rows if r[0] == name]
    assert of("u8") == ["é", "", "b"] and of("latin") == ["é", "b"] and of("le") == ["ਅ一ਅĀ", "", "x"] and of("be") == ["一ਅ"]
    assert of("mark") == [""] and of("one") == [""] and of("none") == [] and of("cr") == ["a\rb\r"]
    # a split of one byte cuts the mark of UTF-8 off no more
    assert [r for r in rows if r[0] in ("latin", "cr", "one")] == [r for r in same if r[0] in ("latin", "cr", "one")]


def test_the_driver_knows_no_small_file(spark, tmp_path):
    for i in range(400):
        (tmp_path / "in" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 3}" / f"{i} %é.log").write_bytes(b"a\r\nb")
    (tmp_path / "in" / "d1" / "large [1].log").write_bytes("\ufeffa\nb\n".encode("utf-16-le") + 600 * b"x\0" + b"\n\0")
    for name in ("_hidden.log", ".hidden.log", "other.txt"):
        (tmp_path / "in" / "d2" / name).write_bytes(b"c")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = scan_encoded_lines(spark, str(tmp_path / "in"), "*.log")
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [f for f in found.inputFiles() if f.startswith(f"file://{tmp_path}/in")] == [f"file://{tmp_path}/in/d1/large%20%5B1%5D.log"]
    lines = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        lines.setdefault(r["path"], []).append((r["line_no"], r["line"]))
    assert lines.pop("d1/large%20%5B1%5D.log") == [(1, "a"), (2, "b"), (3, 600 * "x")]
    assert lines == {f"d{i % 3}/{i}%20%25é.log": [(1, "a"), (2, "b")] for i in range(400)}


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(400):
        (tmp_path / "in" / f"{i}.log").write_bytes(b"a")
    assert scan_encoded_lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_what_a_task_of_the_sink_tells_the_driver(tmp_path):
    writer = FileTreeWriter(str(tmp_path / "out"))
    batch = lambda some: pa.RecordBatch.from_pydict({"path": some, "content": [p.encode() for p in some]})
    paths = [f"d{i % 7}/{i}" for i in range(2 * READ + 500)]
    told = [writer.write(iter([batch(paths[:READ + 300]), batch(paths[READ + 300:2 * READ])])), writer.write(iter([])), writer.write(iter([batch(paths[2 * READ:])]))]
    assert all(len(pickle.dumps(m)) < 1000 for m in told)
    writer.commit([*told, None])
    out = tmp_path / "out"
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == sorted(paths)
    assert all((out / p).read_text() == p for p in paths)
    again = [writer.write(iter([batch(["x", "a", "y"])])), writer.write(iter([batch(["b", "x"])]))]
    with pytest.raises(ValueError, match="several files"):
        writer.commit(again)
    writer.abort(again)
    assert not (out / "a").exists() and not [p for p in out.iterdir() if p.name.startswith("_staging")]


@pytest.mark.parametrize("files", [0, 100, 2000, 60_000, 360_000])
def test_batches_of_waiting_files_are_few(files):
    assert files <= 20 * files_together(files) and files_together(files) >= 100


def test_runs_are_sketched_in_one_pass(spark, tmp_path, monkeypatch):
    spark.range(300).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    passes, of = [], reports.original_sketches
    monkeypatch.setattr(reports, "original_sketches", lambda *a: passes.append(a) or of(*a))
    rows = {r["category"]: r for r in Q.distinct_originals_merged(spark, str(tmp_path)).collect()}
    assert len(passes) == 1 and set(rows) == {"username", "email"} and all(r["close"] for r in rows.values())


def test_a_line_meets_the_rules_side_by_side(spark):
    """A rule inside another for each rule of a stage made a line cost their square, and a match four passes of its pattern."""
    catalogue = Catalogue.builtin()
    begun = cascade.start(spark.createDataFrame([("user=bob mail a@b.com",)], "line string"), "line", catalogue)
    for rules in catalogue.stages():
        plan = cascade.run_stage(begun, rules, catalogue)._jdf.queryExecution().analyzed().toString()
        assert plan.count("aggregate(") == 1
        assert all(plan.count(catalogue.regex(r)) == 1 for r in rules if r.rule_id in (8, 14))


def test_any_number_of_values_in_a_line(spark):
    mails = [" ".join(f"mail m{i % 6}@x.org user={i}" for i in range(n)) for n in range(13)]
    texts = [*mails, "\n".join(mails), "user=a@b.com user=a@b.com", "", "login: u pwd=x 10.0.0.1 site=a"]
    found = redact_documents(spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string"), "text").collect()
    got = {r["i"]: (r["text"], sorted(map(tuple, r["hits"] or []), key=repr)) for r in found}
    assert got.pop(-1)[0] is None
    want = {i: (t, sorted(h, key=repr)) for i, (t, h) in enumerate(map(Model().redact, texts))}
    assert got == want


def test_each_part_of_a_tree_is_written_by_a_task_of_its_own(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(Q, "scratch", lambda spark, name: str(tmp_path / name))
    rows = Q.file_roundtrip(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and all((r["lines"], r["line_nos"]) == (10, 55) for r in rows)
    tasks = [re.match(r"part-(\d+)", p.name)[1] for p in (tmp_path / "tree").rglob("part-*")]
    assert len(tasks) == 8 == len(set(tasks))


def test_a_batch_of_lines_has_a_file_for_each_core(spark, tmp_path, monkeypatch):
    spark.range(6400).select(F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("user_id")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(Q, "scratch", lambda spark, name: str(tmp_path / name))
    Q._stream(spark, str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    assert cores < len([*(tmp_path / "stream" / "in").glob("*.parquet")]) <= 2 * cores


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / "in" / f"d{i}").mkdir(parents=True)
        (tmp_path / "in" / f"d{i}" / "a.log").write_bytes(b"x")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        found = scan_files(spark, str(tmp_path / "in"))
        jobs = sc.statusTracker().getJobIdsForGroup("listing")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert stages and max(sc.statusTracker().getStageInfo(s).numTasks for s in stages) <= 4 * sc.defaultParallelism
    assert found.count() == 100


def test_a_batch_in_one_file_is_spread(spark, tmp_path, monkeypatch):
    seen = {}

    def staged(df, name, kept=blocks.staged):
        seen[name] = df.rdd.getNumPartitions()
        return kept(df, name)
    monkeypatch.setattr(blocks, "staged", staged)
    lines = spark.range(50).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).alias("line_no"), F.lit("user=bob").alias("line")).coalesce(1)
    redactor = blocks.BlockRedactor("doc_id", "line_no", "line", *(str(tmp_path / n) for n in ("out", "dictionary", "carry")))
    redactor(lines, 0)
    assert seen["batch"] == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
