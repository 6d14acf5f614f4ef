"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Files can be 10 MiB each, so Arrow batches that carry texts stay short.
TEXT_BATCH_ROWS = 256

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_BATCH_ROWS),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(app: str = "palisade", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A session without that setting is refused: a folder of one machine would be
    missing on the others.
    """
    base = shared_folder(spark)
    if base is None:
        raise ValueError("name a shared folder in spark.checkpoint.dir, or give a location")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str | None:
    """The folder in ``spark.checkpoint.dir``, else one below a warehouse that is not on a local disk or of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    shared = not warehouse.startswith(("file:", "/")) or spark.sparkContext.master.startswith("local")
    return f"{warehouse.rstrip('/')}/.palisade" if shared else None


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches of a job read, and return it as a scan.

    Cuts the lineage through shared storage: the input is parsed once, later
    branches read pruned columns, and a lost executor costs a re-read only.
    Without a shared folder the plan itself is returned, which is right and only slower.
    Written tables are removed when the session ends.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        return df
    location = scratch_path(spark, name)
    df.write.parquet(location)
    _remove_at_end(spark, location)
    return spark.read.schema(df.schema).parquet(location)


# Rows that a round of a staged table shuffles, if there are no more rounds than are given.
ROUND_ROWS = 1 << 23


def rounds(rows: int, most: int) -> int:
    """Rounds in which a table of so many shuffled rows is staged, ``most`` at most: every round reads its input anew."""
    return max(1, min(most, -(-rows // ROUND_ROWS)))


def in_round(r: int, of: int, *keys: str) -> Column:
    """Whether the keys belong to round ``r``; every key, null ones too, belongs to one of them."""
    return F.pmod(F.xxhash64(*keys), F.lit(of)) == r if of > 1 else F.lit(True)


def stage_parts(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """Stage the rows of all ``parts`` as one table that takes little disk.

    Parts are written one after another, and the shuffled files of one are removed before the next is begun, so that the largest
    part is what a table needs beside its rows.
    """
    spark = parts[0].sparkSession
    if shared_folder(spark) is None:
        return reduce(DataFrame.unionByName, parts)
    location = scratch_path(spark, name)
    _remove_at_end(spark, location)
    with _shuffles_removed(spark):
        for part in parts:
            part.write.mode("append").options(**{"compression": "zstd", "parquet.writer.version": "v2"}).parquet(location)
    staged = spark.read.schema(parts[0].schema).parquet(location)
    staged._staged_at = location
    return staged


def unstage(*tables: DataFrame) -> None:
    """Remove tables of :func:`stage_parts` that no plan reads any more, before the session ends."""
    for table in tables:
        if location := getattr(table, "_staged_at", None):
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs begun herein remove their shuffled files when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _remove_at_end(spark: SparkSession, location: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
