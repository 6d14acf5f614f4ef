"""Incremental corpus ingest: new files become chunk vectors exactly once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import paths as P
from ..operators import chunks as C, select as S, vectors as V
from ..sources import corpus
from ..sources.store import ChunkStore

STORED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("repo_id", T.StringType()),
    ]
)


def chunk_vectors(files: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Chunks of accepted files with their vectors, in the layout of the store."""
    described = files.select(
        "repo_id", "path", "ord", "content", P.display_language(P.raw_extension("path")).alias("language"),
        P.extension("path").alias("extension"),
    )
    return V.encode(C.chunks(described), "content", model=model).select(*[f.name for f in STORED])


def ingest_batch(store: ChunkStore, batch: DataFrame, name: str | None = None) -> None:
    """Append the files of a batch that no other batch has stored yet.

    A batch that is replayed under its ``name`` is written anew in the place of
    whatever its first attempt has left, so the table stays exact when an
    executor or the driver is lost in between.  The first of equal paths inside
    a batch is kept.
    """
    accepted = corpus.filter_files(batch)
    first = accepted.groupBy("repo_id", P.normalise("path").alias("__norm")).agg(F.min("ord").alias("ord"))
    fresh = accepted.withColumn("__norm", P.normalise("path")).join(
        first, ["repo_id", "__norm", "ord"], "left_semi"
    ).drop("__norm")
    # Only the partitions of the batch's repositories are looked at.
    other = store.batches() if name is None else store.batches().filter(F.col("batch") != name)
    stored = other.select("repo_id", "path").join(first.select("repo_id").distinct(), "repo_id", "left_semi")
    store.append(chunk_vectors(S.not_indexed(fresh, stored)), name)


def start(files: DataFrame, store: ChunkStore, checkpoint: str, available_now: bool = False):
    """Start the stream ``files`` -> chunk store; returns the streaming query."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()  # batches are numbered within a stream
    writer = files.writeStream.foreachBatch(lambda df, n: ingest_batch(store, df, f"{stream}-{n}")).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def open_store(spark: SparkSession, location: str) -> ChunkStore:
    return ChunkStore(spark, location, STORED)
