"""Corpus scans and document ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session
from ..functions import paths as P
from . import tree


def keep_path(path: Column | str, strict_globs: bool = False) -> Column:
    """Path part of the scan filter: not ignored, not a test path."""
    return ~P.is_ignored(path, strict_globs) & ~P.is_test_path(path)


def _reasons(path: Column, size: Column, strict_globs: bool, max_bytes: int | None) -> Column:
    """Why a file is skipped by its metadata, null if it is not."""
    large = F.when(size > max_bytes, "too large") if max_bytes is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(P.is_ignored(path, strict_globs), "ignored"), F.when(P.is_test_path(path), "test"), large)


def filter_files(files: DataFrame, strict_globs: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Scan filter over a ``files`` table: a condition on paths (and sizes, if limited), never on texts.

    Texts of a table are strings and were checked when they were read; bytes are checked here.
    """
    kept = files.filter(keep_path("path", strict_globs))
    if max_bytes is not None:
        kept = kept.filter(F.col("length") <= max_bytes)
    if dict(files.dtypes).get("content") == "binary":
        kept = kept.filter(F.is_valid_utf8(F.col("content").cast("string")))
    return kept


def scan_files(
    spark: SparkSession, root: str, strict_globs: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """Text files below ``root/<repo_id>/``: ``repo_id, path, content, length``, paths relative to the repository.

    Every name is listed, also those with a leading dot or underscore. Ignored directories are not entered, and files that
    the conditions on path and size leave out are never opened; they look at the path below the repository, whose name may
    be anything. ``max_bytes`` leaves out larger files; none is left out by default, and :func:`skipped_files` tells which and
    why. :func:`numbered` adds the order of files.
    """
    listed = tree.list_files(spark, root, enter=keep_path("path", strict_globs))
    kept = listed.filter(_reasons(F.col("path"), F.col("length"), strict_globs, max_bytes).isNull())
    raw = F.col("content").cast("string")
    return tree.read_files(kept, root).filter(F.col("content").isNotNull() & F.is_valid_utf8(raw)).select("repo_id", "path", raw.alias("content"), "length")


def skipped_files(
    spark: SparkSession, root: str, strict_globs: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """``repo_id, path, reason`` of every file that :func:`scan_files` leaves out, ignored directories included."""
    why = _reasons(F.col("path"), F.col("length"), strict_globs, max_bytes)
    listed = session.stage(tree.list_files(spark, root).withColumn("reason", why), "skipped")
    text = F.is_valid_utf8(F.col("content").cast("string"))
    opened = tree.read_files(listed.filter("reason IS NULL"), root).select(
        "repo_id", "path", F.when(F.col("content").isNull(), "unreadable").when(~text, "not text").alias("reason")
    )
    return listed.select("repo_id", "path", "reason").unionByName(opened).filter("reason IS NOT NULL")


def numbered(files: DataFrame) -> DataFrame:
    """Add ``ord``, a place of each file in its repository that grows with the path.

    Places come from a sort by ranges of paths, numbered within its partitions: unique, growing, and with gaps.
    """
    ranged = files.repartitionByRange("repo_id", "path").sortWithinPartitions("repo_id", "path")
    return ranged.withColumn("ord", F.monotonically_increasing_id())


def decode(content: Column | str) -> Column:
    """Bytes to text, invalid sequences become replacement characters."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))


def ingest_documents(docs: DataFrame) -> DataFrame:
    """Documents with a path (own or from the metadata), non-empty content and no test path."""
    path = F.coalesce(F.col("file_path"), F.col("metadata.file_path"), F.lit(""))
    return (
        docs.withColumn("path", path)
        .filter((F.coalesce("content", F.lit("")) != "") & (F.col("path") != "") & ~P.is_test_path("path"))
        .drop("file_path")
    )


def read_documents(spark: SparkSession, location: str) -> DataFrame:
    """JSON documents with the declared schema."""
    from .. import schemas

    return ingest_documents(spark.read.schema(schemas.DOCUMENTS).json(location))
