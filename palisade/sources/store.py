"""The chunk/vector table: partitioned by repository and batch, replaced or appended per repository."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException


def _laid_out(df: DataFrame) -> DataFrame:
    """Even output files: small repositories are packed together, large ones split."""
    return df.hint("rebalance", "repo_id")


class ChunkStore:
    """A Parquet table of chunks below ``location``.

    Each append is a batch, a partition below each of its repositories: writing a batch again replaces what an attempt
    that was lost in between has left of it.
    """

    def __init__(self, spark: SparkSession, location: str, schema: T.StructType):
        self.spark, self.location, self.schema = spark, location, schema

    def save(self, df: DataFrame) -> None:
        """Replace the repositories that occur in ``df``, leave the others."""
        batch = f"saved-{uuid.uuid4().hex}"
        self.append(df, batch)
        fresh = self.batches().filter(F.col("batch") == batch).select("repo_id").distinct()
        # Only the names of partitions are asked for: no row of the table is read or passes the driver.
        old = self.batches().select("repo_id", "batch").filter(F.col("batch") != batch).join(fresh, "repo_id", "left_semi").distinct()
        for row in old.toLocalIterator():
            self._drop(row["repo_id"], row["batch"])

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Add rows; those of a named batch take the place of an earlier attempt at it."""
        named = df.withColumn("batch", F.lit(batch or f"added-{uuid.uuid4().hex}"))
        (
            _laid_out(named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("repo_id", "batch").parquet(self.location)
        )

    def batches(self) -> DataFrame:
        """The table with the batch of each row, empty when nothing has been saved yet."""
        whole = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        try:
            return self.spark.read.schema(whole).parquet(self.location)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], whole)

    def load(self) -> DataFrame:
        return self.batches().drop("batch")

    def _drop(self, repo_id: str, batch: str) -> None:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/repo_id={escape(repo_id)}/batch={escape(batch)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """An overwrite with no rows and no partition drops all repositories."""
        empty = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(""))
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("repo_id", "batch").parquet(
            self.location
        )

    def repositories(self) -> DataFrame:
        return self.load().select("repo_id").distinct()

    def sizes(self) -> DataFrame:
        return self.load().groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunks"))
