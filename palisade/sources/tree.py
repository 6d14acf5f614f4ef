"""Whole file trees as tables: every name is listed, in tasks, and files are read and written there.

Spark's file readers hide names that begin with a dot or an underscore. Here directories are listed level by level with
Arrow's file systems, so a task lists some directories of one level, whatever their repository, and files are opened
only after a filter of the listing.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session

# Bytes of files that one task reads, about, and bytes and files of one batch.
TASK_BYTES, BATCH_BYTES, BATCH_FILES = 128 << 20, 16 << 20, 256

LISTED = "path string, is_dir boolean, length long"
FILES = "repo_id string, path string, length long, content binary"


def open_tree(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and its path there. ``s3a`` is read as ``s3``; paths without a scheme are local."""
    if "://" in root or root.startswith("file:"):
        scheme, rest = root.split(":", 1)
        uri = f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{'s3' if scheme == 's3a' else scheme}:{rest}"
        system, base = pyarrow.fs.FileSystem.from_uri(uri)
        return system, base.rstrip("/")
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(root)


def _children(root: str):
    """Task function: the entries of every directory in ``path``, below ``root``. Linked directories are not entered."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_tree(root)
        local = system.type_name == "local"
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                entries = system.get_file_info(pyarrow.fs.FileSelector(f"{base}/{folder}" if folder else base))
                rows = [
                    (posixpath.join(folder, e.base_name), e.type == pyarrow.fs.FileType.Directory, e.size)
                    for e in entries
                    if e.type == pyarrow.fs.FileType.File or e.type == pyarrow.fs.FileType.Directory and not (local and os.path.islink(e.path))
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * 3
                kinds = (pa.string(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "is_dir", "length"])

    return listed


def below(path: Column) -> Column:
    """The part of a path that follows its first folder, empty if there is none."""
    return F.when(F.contains(path, F.lit("/")), path.substr(F.instr(path, F.lit("/")) + 1, F.length(path))).otherwise("")


def list_files(spark: SparkSession, root: str, enter: Column | None = None) -> DataFrame:
    """All files below ``root/<repo_id>/``: ``repo_id, path, length``, whatever their names.

    ``enter``, a condition on ``path`` (below the repository), says which directories are listed; all by default. There are as
    many jobs as the tree has levels; the listing of each is written, and directories of a level are dealt to tasks by their
    names, so that neither a deep nor a wide repository is one task's. A directory's own entries are listed by one task.
    """
    tasks = max(2, spark.sparkContext.defaultParallelism)
    level = spark.createDataFrame([("",)], "path string")
    found = []
    while True:
        entries = session.stage(level.mapInArrow(_children(root), LISTED), "listing")
        found.append(entries.filter(~F.col("is_dir")).select("path", "length"))
        folders = entries.filter("is_dir").select("path")
        if enter is not None:
            inner = folders.withColumns({"whole": F.col("path"), "path": below(F.col("path"))})
            folders = inner.filter((F.col("path") == "") | enter).select(F.col("whole").alias("path"))
        if folders.isEmpty():
            break
        level = folders.repartition(tasks, "path")
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    path = F.col("path")
    return files.filter(F.contains(path, F.lit("/"))).select(F.substring_index(path, "/", 1).alias("repo_id"), below(path).alias("path"), "length")


def read_files(files: DataFrame, root: str) -> DataFrame:
    """Add the bytes of listed files: ``FILES``; null for a file that cannot be opened.

    Files are dealt to as many tasks as their bytes ask for; a batch holds few files, a larger one alone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_tree(root)
        names = ["repo_id", "path", "length", "content"]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for repo_id, path, length in zip(*(batch.column(c).to_pylist() for c in names[:3]), strict=True):
                try:
                    with system.open_input_stream(f"{base}/{repo_id}/{path}") as stream:
                        content = stream.read()
                except OSError:
                    content = None
                rows.append((repo_id, path, length, content))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spark = files.sparkSession
    size = files.agg(F.sum("length")).head()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return files.select("repo_id", "path", "length").repartition(int(tasks), "repo_id", "path").mapInArrow(read, FILES)


def write_files(files: DataFrame, root: str) -> int:
    """Write ``repo_id, path, content`` as one file each below ``root/<repo_id>/``, in tasks; the number of files.

    A task that runs again writes the same bytes to the same names. Rows with a null in any of the three are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_tree(root)
        made: set[str] = set()
        count = 0
        for batch in batches:
            for repo_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "content")), strict=True):
                place = f"{base}/{repo_id}/{path}"
                folder = posixpath.dirname(place)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(place) as stream:
                    stream.write(content)
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    rows = files.select("repo_id", "path", F.col("content").cast("binary").alias("content")).na.drop()
    return rows.mapInArrow(write, "files long").agg(F.sum("files")).head()[0] or 0
