"""Trees of files beyond what Spark's own sources do.

Writing: a sink that writes rows as files of a tree, all of them or none.

Each task writes its files under a staging folder inside the target; only when
all tasks are done does the driver move them to their places and delete the
staging folder, with whatever lost or repeated tasks left there.  What reaches
the driver is a folder for each task; the paths wait beside the files, sorted,
and are read a few at a time.  Files are written through the file systems of
pyarrow, so the target is a shared folder, S3, GCS or HDFS.

Reading: Spark's readers leave out empty files and names that begin with an
underscore or a dot.  ``unseen_files`` reads just these, so that none is lost.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from heapq import merge
from itertools import batched, chain, pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from logveil.functions import files as P

FORMAT = "filetree"
#: Unseen files that one task reads.
TOGETHER = 100
#: Files that the driver moves at a time.
MOVED = 16
#: Paths that the driver reads at a time, of each task or for each file that it moves.
READ = 1000
PATHS = "paths"


@dataclass
class _Written(WriterCommitMessage):
    """A folder of staged files, with the paths, relative to the target, where they belong."""

    folder: str


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _staged_paths(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, str]]:
    """Paths in order, each with its staged file; only ``READ`` of them are held, and no file is kept open."""
    at, last = 0, 1
    while at < last:
        with store.open_input_file(posixpath.join(folder, PATHS)) as file:
            found = pa.ipc.open_file(file)
            last = found.num_record_batches
            rows = found.get_batch(at).to_pydict() if at < last else {"path": [], "staged": []}
        yield from ((path, posixpath.join(folder, str(i))) for path, i in zip(rows["path"], rows["staged"]))
        at += 1


class FileTreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.staging = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _open(self.root)
        folder, done = posixpath.join(root, self.staging, uuid.uuid4().hex), []
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if path is None or set(path.split("/")) & {"", ".", ".."}:
                    raise ValueError(f"not a path inside the target: {path!r}")
                with store.open_output_stream(posixpath.join(folder, str(len(done)))) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                done.append(path)
        order = sorted(range(len(done)), key=done.__getitem__)
        paths = pa.table({"path": pa.array([done[i] for i in order], "string"), "staged": pa.array(order, "int64")})
        with store.open_output_stream(posixpath.join(folder, PATHS)) as out, pa.ipc.new_file(out, paths.schema) as file:
            file.write_table(paths, max_chunksize=READ)
        return _Written(folder)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.root)
        tasks = [_staged_paths(store, m.folder) for m in messages if m]
        if any(a == b for (a, _), (b, _) in pairwise(merge(*tasks))):
            raise ValueError("several files for one path")
        made: set[str] = set()

        def move(files: tuple[tuple[str, str], ...]) -> None:
            for path, staged in files:
                store.move(staged, posixpath.join(root, path))
        with ThreadPoolExecutor(MOVED) as pool:
            files = chain.from_iterable(_staged_paths(store, m.folder) for m in messages if m)
            for some in batched(files, MOVED * READ):
                folders = {posixpath.dirname(path) for path, _ in some} - made
                for _ in pool.map(lambda folder: store.create_dir(posixpath.join(root, folder), recursive=True), folders):
                    pass
                made = folders if len(made) > MOVED * READ else made | folders
                for _ in pool.map(move, batched(some, max(1, len(some) // MOVED))):
                    pass
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _open(self.root)
        folder = posixpath.join(root, self.staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class UnseenReader(DataSourceReader):
    """``(path, content)`` of the files that Spark's readers leave out, ``TOGETHER`` of them in a task."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def partitions(self) -> list[_Files]:
        store, root = _open(self.root)
        root = root.rstrip("/") + "/"
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        names = sorted(f.path.removeprefix(root) for f in found if not f.size or any(
            p[0] in "._" and not (p[0] == "_" and "=" in p) for p in f.path.removeprefix(root).split("/")))
        return [_Files(names[i:i + TOGETHER]) for i in range(0, len(names), TOGETHER)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, bytes]]:
        store, root = _open(self.root)
        for path in partition.paths:
            with store.open_input_stream(posixpath.join(root, path)) as content:
                yield path, content.read()


class FileTree(DataSource):
    """Rows of ``(path, content)`` below the folder ``path``: written as files, read from those that are unseen."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> UnseenReader:
        return UnseenReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"])


def write_tree(spark: SparkSession, files: DataFrame, target: str, safe_names: bool = True) -> None:
    """Write ``(path, content)`` as files below ``target``, by default under names that are safe on every system.

    Equal files of an earlier run are replaced, others stay.
    """
    spark.dataSource.register(FileTree)
    files.select(F.expr(P.sanitized_path("path") if safe_names else "path").alias("path"), F.col("content").cast("binary").alias("content")) \
        .write.format(FORMAT).mode("append").option("path", target).save()


def unseen_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, content)`` of the files below ``root`` that ``scan_files`` does not see."""
    spark.dataSource.register(FileTree)
    return spark.read.format(FORMAT).option("path", root).load().select("path", F.octet_length("content").cast("bigint").alias("size"), "content")
