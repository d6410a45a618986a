"""Reading file trees and logs, and writing redacted ones."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.functions import files as P
from logveil.functions import text as T
from logveil.sources.staging import staged

BROADCAST_SPLITS = 200_000
#: Bytes up to which a file that lies in one split is read as a whole.
WHOLE_BYTES = 4 * 1024 * 1024
#: Bytes and files, whichever is reached first, that one task reads of files read as a whole, and that it passes on together.
TASK_BYTES, TASK_FILES = 128 * 1024 * 1024, 20_000
PASSED_BYTES, PASSED_FILES = 8 * 1024 * 1024, 5_000


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, size, content)`` of every file below ``root``; paths are relative to it.

    Selecting only ``path`` and ``size`` lists the tree without reading it.
    """
    list_together(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", glob).load(root)
    return found.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"), "content")


def list_together(spark: SparkSession) -> None:
    """Let a task list many folders: by default each has one, and as many results go to the driver."""
    if spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) is None:
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))


def relative_path(path: Column, root: str) -> Column:
    """Cut the scheme and the root off a path."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(bare, "^" + _quoted(root.split("://")[-1].rstrip("/")) + "/", "")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def manifest(files: DataFrame) -> DataFrame:
    """Files with their class by name and by size."""
    return files.select("path", "size", F.expr(P.file_class("path")).alias("class"),
                        F.expr(P.size_class("size")).alias("size_class"))


def text_files(files: DataFrame) -> DataFrame:
    """The files to redact, decoded: names say text, and so does all of the content."""
    return files.filter(f"{P.route('path', 'content')} = 'redacted'").withColumn("text", F.expr(P.decoded("content"))).drop("content")


def untouched_files(files: DataFrame) -> DataFrame:
    """The files to pass on as they are: those whose names do not say text."""
    return files.filter(f"{P.route('path', 'content')} = 'copied'")


def rejected_files(files: DataFrame) -> DataFrame:
    """The files named as text that cannot be read as such, with the reason as ``error``; never to be passed on."""
    return files.filter(f"{P.route('path', 'content')} = 'quarantined'") \
        .withColumn("error", F.expr(f"coalesce({P.decoding_error('content')}, 'looks binary')"))


def scan_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, line_no, line)`` of logs of any size, with exact line numbers.

    A file is read in splits.  A first pass counts the lines of each, without
    keeping them; the second adds what precedes a split to the place within it.
    No file passes through one task, and no line is moved to be numbered.  Only a
    line feed ends a line, and one carriage return before it is cut off.  The
    job fails if the second pass meets a split that the first one did not.
    """
    return _numbered(spark, root, glob).select("path", "line_no", F.regexp_replace(F.col("_bytes").cast("string"), r"\r\z", "").alias("line"))


def _numbered(spark: SparkSession, root: str, glob: str, larger_than: int = -1, paths: list[str] | None = None) -> DataFrame:
    """``(path, line_no, _bytes)`` of files in an encoding in which a line feed is one byte."""
    lines = _raw_lines(spark, root, paths or root, glob, "UTF-8", larger_than).drop("_file")
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(lines.groupBy("path", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_from")).select(
        "path", "_split", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "splits")
    if starts.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    changed = F.raise_error(F.concat(F.lit("changed between two passes: "), "path"))
    return lines.join(starts, ["path", "_split"], "left").select("path", F.when(F.col("_from").isNull(), changed).otherwise(
        F.col("_before") + F.col("_at") - F.col("_from") + 1).alias("line_no"), "_bytes")


def _raw_lines(spark: SparkSession, root: str, paths: str | list[str], glob: str, encoding: str, larger_than: int = -1) -> DataFrame:
    """``(path, _split, _at, _bytes)``: the bytes between the line feeds of an encoding; files of up to ``larger_than`` bytes are not opened."""
    list_together(spark)
    # All passes must cut the files alike, however many executors there are by then.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").option("encoding", encoding)
    found = found.text(paths)
    if larger_than >= 0:
        found = found.filter(F.col("_metadata.file_size") > larger_than)
    return found.select(
        relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("_bytes"))


def file_encodings(spark: SparkSession, root: str, glob: str = "*", larger_than: int = -1, paths: list[str] | None = None) -> DataFrame:
    """``(path, _file, encoding)`` of logs of any size, told from the whole of each.

    A file is read in splits.  No line feed is part of a longer UTF-8 character, so
    a file is UTF-8 if all of its lines are, wherever it is cut.
    """
    lines = _raw_lines(spark, root, paths or root, glob, "UTF-8", larger_than)
    told = lines.groupBy("path", "_file").agg(
        F.bool_and(F.expr("is_valid_utf8(cast(_bytes AS string))")).alias("_valid"),
        F.min(F.struct("_split", "_at", F.hex(F.substring("_bytes", 1, 2)).alias("mark")))["mark"].alias("_mark"))
    return told.select("path", "_file", F.expr(
        "CASE _mark WHEN 'FFFE' THEN 'UTF-16LE' WHEN 'FEFF' THEN 'UTF-16BE' ELSE IF(_valid, 'UTF-8', 'ISO-8859-1') END").alias("encoding"))


def _wide_lines(raw: DataFrame, encoding: str) -> DataFrame:
    """``(path, line_no, _bytes)`` of UTF-16 files.

    The two bytes of a line feed can also be halves of two other characters.  A
    true line begins at an even place of its file, so the pieces from one such
    place to the next are one line.  Only files with a piece of odd length have
    any, and only their pieces are moved.
    """
    splits = staged(raw.groupBy("path", "_split").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_from"), F.sum(F.octet_length("_bytes")).alias("_size"),
        F.bool_or(F.octet_length("_bytes") % 2 == 1).alias("_odd")), "splits")
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = staged(splits.select(
        "path", "_split", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"), F.bool_or("_odd").over(Window.partitionBy("path")).alias("_odd")), "splits")
    placed = raw.join(F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits, ["path", "_split"])
    whole = placed.filter("NOT _odd").select("path", (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias("line_no"), "_bytes")
    within = Window.partitionBy("path", "_split").orderBy("_at")
    pieces = placed.filter("_odd").withColumn("_place", F.col("_offset") + F.coalesce(
        F.sum(F.octet_length("_bytes")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = staged(pieces.withColumn("_begins", (F.col("_place") % 2 == 0).cast("int")).withColumn(
        "_line", F.sum("_begins").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select(
        "path", "_split", "_at", "_bytes", "_begins", "_line"), "pieces")
    begun = pieces.groupBy("path", "_split").agg(F.sum("_begins").alias("_n")).select(
        "path", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    feed = "X'0A00'" if encoding == "UTF-16LE" else "X'000A'"
    joined = (f"aggregate(array_sort(collect_list(struct(_split, _at, _bytes))), cast(NULL AS binary), "
              f"(a, x) -> IF(a IS NULL, x._bytes, concat(a, {feed}, x._bytes)))")
    mended = pieces.join(begun, ["path", "_split"]).groupBy("path", (F.col("_before") + F.col("_line")).alias("line_no")) \
        .agg(F.expr(joined).alias("_bytes"))
    return whole.unionByName(mended)


def scan_encoded_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, line_no, line)`` of logs of any size in UTF-8, UTF-16 with a byte order mark, or else Latin-1.

    As ``scan_lines``, which takes every file for UTF-8; a pass over the bytes tells the encodings first.
    A small file is a row, opened once.  Of larger ones no file passes through one task.  Below a folder
    that is no store of its own, tasks list the files too, and the driver knows the larger ones only.
    """
    small = min(WHOLE_BYTES, int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))))
    folder, larger = _folder(spark, root), None
    if folder is None:
        found = scan_files(spark, root, glob).filter(F.col("_metadata.file_size").between(1, small))
    else:
        listed = _listed(spark, folder, glob)
        larger = [_literal_path(os.path.join(folder, r["path"])) for r in listed.filter(F.col("size") > small).select("path").collect()]
        found = _contents(listed.filter(F.col("size").between(1, small)), folder).withColumn("path", relative_path(F.col("path"), root))
    whole = _whole_lines(found)
    if larger == []:
        return whole
    encodings = staged(file_encodings(spark, root, glob, small, larger), "encodings")
    many = encodings.count()
    if not many:
        return whole
    return whole.unionByName(_split_lines(spark, root, glob, small, encodings, many, larger))


def _folder(spark: SparkSession, root: str) -> str | None:
    """The path of a folder that tasks can open by themselves, on disks of their own or shared ones; none for what only a store reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return full.getPath() if full.getScheme() == "file" and os.path.isdir(full.getPath()) else None


def _literal_path(path: str) -> str:
    """A path as Spark's readers take it, to whom it is a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(path, size)`` of the files that Spark's readers see below a folder, listed by tasks: a folder by one, level by level."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    levels, folders, most = [], spark.range(1).select(F.lit("").alias("path")), 4 * spark.sparkContext.defaultParallelism
    many = 1
    while many:
        levels.append(staged(folders.repartition(min(many, most)).mapInArrow(_entries(root), "path string, size bigint"), "listing"))
        folders = levels[-1].filter("size IS NULL").select("path")
        many = folders.count()
    return reduce(DataFrame.unionByName, levels).filter(F.col("size").isNotNull() & F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{named})\z"))


# What follows runs in tasks by itself, lest workers that read need this package.

def _entries(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What folders hold that Spark's readers see: files with their sizes, and folders without."""
    together = PASSED_FILES

    def is_seen(name: str, folder: bool) -> bool:
        return folder and name.startswith(("_metadata", "_common_metadata")) or not (
            name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            paths, sizes = [], []
            with os.scandir(os.path.join(root, folder)) as entries:
                for entry in entries:
                    if not is_seen(entry.name, entry.is_dir()):
                        continue
                    try:
                        sizes.append(None if entry.is_dir() else entry.stat().st_size)
                    except FileNotFoundError:  # gone since, or a link to nothing
                        continue
                    paths.append(os.path.join(folder, entry.name))
                    if len(paths) >= together:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, "string"), pa.array(sizes, "int64")], ["path", "size"])
                        paths, sizes = [], []
            yield pa.RecordBatch.from_arrays([pa.array(paths, "string"), pa.array(sizes, "int64")], ["path", "size"])
    return run


def _reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The files of the paths, under the names that ``_metadata.file_path`` has."""
    most, together = PASSED_BYTES, PASSED_FILES
    quoted = re.compile(r"[^A-Za-z0-9\-_.!~*'():@&=+$,;/\u00a0-\U0010ffff]|[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            path = os.path.join(root, path)
            with open(path, "rb") as file:
                contents.append(file.read())
            paths.append("file://" + quoted.sub(lambda found: "".join(f"%{b:02X}" for b in found[0].encode()), path))
            size += len(contents[-1])
            if size >= most or len(paths) >= together:
                yield pa.RecordBatch.from_arrays([pa.array(paths, "string"), pa.array(contents, "binary")], ["path", "content"])
                paths, contents, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, "string"), pa.array(contents, "binary")], ["path", "content"])
    return run


def _contents(listed: DataFrame, root: str) -> DataFrame:
    """``(path, content)`` of files, dealt to as many tasks as their bytes and their number want."""
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total["bytes"] // TASK_BYTES), -(-total["files"] // TASK_FILES))
    return listed.select("path").repartition(tasks).mapInArrow(_reader(root), "path string, content binary")


def _whole_lines(files: DataFrame) -> DataFrame:
    """``(path, line_no, line)`` of files held as rows, with the same rules."""
    # Spark's reader of text cuts this mark off as well
    found = files.select("path", F.expr("IF(startswith(content, X'EFBBBF'), substring(content, 4), content)").alias("_bytes"))
    text = ("CASE hex(substring(_bytes, 1, 2)) WHEN 'FFFE' THEN decode(_bytes, 'UTF-16LE') WHEN 'FEFF' THEN decode(_bytes, 'UTF-16BE') "
            "ELSE IF(is_valid_utf8(cast(_bytes AS string)), cast(_bytes AS string), decode(_bytes, 'ISO-8859-1')) END")
    marked = "hex(substring(_bytes, 1, 2)) IN ('FFFE', 'FEFF')"
    lines = T.let("cut", f"split({text}, '\\n', -1)", "IF(element_at(cut, -1) = '', slice(cut, 1, size(cut) - 1), cut)")
    return found.select("path", F.expr(marked).alias("_marked"), F.posexplode(F.expr(lines)).alias("_at", "_line")).select(
        "path", (F.col("_at") + 1).cast("bigint").alias("line_no"), F.regexp_replace(F.when(
            F.col("_marked") & (F.col("_at") == 0), F.regexp_replace("_line", "^\ufeff", "")).otherwise(F.col("_line")), r"\r\z", "").alias("line"))


def _split_lines(spark: SparkSession, root: str, glob: str, larger_than: int, encodings: DataFrame, many: int, paths: list[str] | None) -> DataFrame:
    """``(path, line_no, line)`` of files with their ``encodings``, read in splits."""
    narrow = encodings.filter("encoding NOT LIKE 'UTF-16%'")
    if many <= BROADCAST_SPLITS:
        narrow = F.broadcast(narrow)
    decoded = F.expr("IF(encoding = 'UTF-8', cast(_bytes AS string), decode(_bytes, 'ISO-8859-1'))")
    found = _numbered(spark, root, glob, larger_than, paths).join(narrow.select("path", "encoding"), "path") \
        .select("path", "line_no", F.regexp_replace(decoded, r"\r\z", "").alias("line"))
    for encoding in ("UTF-16LE", "UTF-16BE"):
        # as many paths as the listing of the files had held already
        paths = [_literal_path(unquote(r["_file"])) for r in encodings.filter(F.col("encoding") == encoding).select("_file").collect()]
        if paths:
            wide = _wide_lines(_raw_lines(spark, root, paths, "*", encoding), encoding)
            line = F.regexp_replace(F.decode("_bytes", encoding), r"\r\z", "")
            found = found.unionByName(wide.select("path", "line_no", F.when(
                F.col("line_no") == 1, F.regexp_replace(line, "^\ufeff", "")).otherwise(line).alias("line")))
    return found


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line_no, line)`` of documents held as rows."""
    return docs.select(id_col, F.posexplode(F.expr(T.split_lines(text_col))).alias("line_no", "line")) \
        .withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def join_lines(lines: DataFrame, id_col: str, line_no_col: str, line_col: str, text_name: str = "text") -> DataFrame:
    """``(id, text)``: documents back from their lines, a missing line as an empty one.

    A document is a row, so it must fit one; longer logs stay as lines (``redact_lines``).
    """
    return lines.groupBy(id_col).agg(F.expr(
        f"array_join(transform(array_sort(collect_list(struct({line_no_col}, {line_col}))), x -> coalesce(x.{line_col}, '')), '\\n')")
        .alias(text_name))


def write_redacted(df: DataFrame, target: str, path_col: str = "path") -> None:
    """Redacted documents as a table, with output paths safe on every system."""
    df.withColumn(path_col, F.expr(P.sanitized_path(path_col))).write.mode("overwrite").parquet(target)


def write_lines(lines: DataFrame, target: str, path_col: str = "path", line_no_col: str = "line_no",
                line_col: str = "line") -> None:
    """Redacted lines as text files below one folder per source file, in line order.

    Ranges of lines, not whole files, make up a task, so one huge file is spread.
    """
    lines.withColumn("file", F.expr(P.sanitized_path(path_col))) \
        .repartitionByRange("file", path_col, line_no_col).sortWithinPartitions("file", path_col, line_no_col) \
        .select("file", F.col(line_col).alias("value")).write.mode("overwrite").partitionBy("file").text(target)
