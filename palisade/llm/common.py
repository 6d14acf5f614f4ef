"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

# Texts can be large, so an Arrow batch that carries them holds few rows.
TEXT_BATCH_ROWS = 256
BATCH_SETTING, WRITTEN_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place below the folder that the cluster names in ``spark.checkpoint.dir``.

    Without that setting a folder below the warehouse serves local sessions (tests), and any session whose warehouse is not on a
    machine's own disk; others are refused, since their executors would each write to a folder that no other one sees.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        base = f"{warehouse.rstrip('/')}/.shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to shared storage and return it as a scan: cuts the lineage, survives lost executors.

    Python gets ``batch_rows`` rows at once, else few. The table goes when the session's driver ends.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with short_batches(spark, batch_rows):
        df.write.parquet(path)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Texts go to Python in batches of few rows, or of ``rows``, while a table is written; the session's own setting comes back after."""
    own = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(rows or (min(int(own), WRITTEN_BATCH_ROWS) if int(own) > 0 else WRITTEN_BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, own)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names and types, and nothing else: ``only(df, doc_id="id:long")``.

    Whatever else the input carries cannot clash with an operator's own columns.
    """
    picked = []
    for name, spec in columns.items():
        source, kind = spec.rsplit(":", 1)
        picked.append(F.col(f"`{source}`").cast(kind).alias(name))
    return df.select(*picked)


def rows_below(batches, limit: int):
    """Re-slice Arrow batches so that none has more than ``limit`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            yield batch.slice(at, limit)


def per_worker(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks, such as a loaded tokenizer.

    Functions travel to workers by value, with fresh globals each time, so the store is an entry of ``sys.modules``.
    """
    store = sys.modules.setdefault("_palisade_worker", types.ModuleType("_palisade_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
