"""Persisted results: threat model JSON, diagram and report text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.errors import AnalysisException

from .. import schemas
from ..functions.ordering import with_position

PART_THREATS = 1000


def threat_model(owners: DataFrame, threats: DataFrame, risk: DataFrame, part: int = PART_THREATS) -> DataFrame:
    """Nested threat model: one row per owner with its threats as an array.

    An owner with more than ``part`` threats continues in further rows
    (``part`` 1, 2, ...), so no row and no task ever holds an unbounded owner.
    """
    keys = ["repo_id", "owner_kind", "owner"]
    numbered = with_position(threats, keys, "ordinal", "__pos").withColumn(
        "part", F.floor((F.col("__pos") - 1) / part).cast("long")
    )
    fields = [f.name for f in schemas.THREAT]
    nested = numbered.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("threats")
    )
    return (
        owners.select(*keys).distinct()
        .join(nested, keys, "left")
        .join(risk.select("repo_id", "overall_risk"), "repo_id", "left")
        .select(
            "repo_id", "overall_risk", "owner_kind", "owner", F.coalesce("part", F.lit(0)).cast("long").alias("part"),
            F.coalesce("threats", F.from_json(F.lit("[]"), "array<" + schemas.THREAT.simpleString() + ">")).alias(
                "threats"
            ),
        )
    )


def save_threat_model(model: DataFrame, location: str) -> None:
    model.hint("rebalance").write.mode("overwrite").option("ignoreNullFields", "false").json(location)


def load_threat_model(spark: SparkSession, location: str, tech_stacks: DataFrame | None = None) -> DataFrame:
    """A saved threat model; without one, an empty model per repository of ``tech_stacks``."""
    try:
        return spark.read.schema(schemas.THREAT_MODEL).json(location)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    empty = spark.createDataFrame([], schemas.THREAT_MODEL)
    if tech_stacks is None:
        return empty
    return tech_stacks.select("repo_id").distinct().select(
        "repo_id", F.lit("Unknown").alias("overall_risk"), *[F.lit(None).cast(f.dataType).alias(f.name)
                                                              for f in schemas.THREAT_MODEL.fields[2:]],
    )


def model_threats(model: DataFrame) -> DataFrame:
    """Flat threat rows of a nested model."""
    return model.select("repo_id", "owner_kind", "owner", F.explode("threats").alias("t")).select(
        "repo_id", "owner_kind", "owner", "t.*"
    )


def save_tables(spark: SparkSession, tables: dict[str, DataFrame], location: str) -> None:
    """Tables of a model as JSON lines below ``location/<name>/rows``, each with its schema beside it."""
    for name, table in tables.items():
        # Rows stay where they are: spreading them once more would move the whole table for the sake of even files.
        table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{location}/{name}/rows")
        spark.createDataFrame([(table.schema.json(),)], "value string").write.mode("overwrite").text(f"{location}/{name}/schema")


def load_tables(spark: SparkSession, location: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables saved by :func:`save_tables`, with the types they had."""

    def load(name: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{location}/{name}/schema").head()[0]))
        return spark.read.schema(schema).json(f"{location}/{name}/rows")

    return {name: load(name) for name in names}


def save_text(lines: DataFrame, location: str, order: list[str], files: int | None = None) -> None:
    """Write line tables as text below ``location/repo_id=<id>/``.

    The lines are range-partitioned by (repository, order), so a large document
    spreads over several part files whose name order is the document order.
    """
    keys = ["repo_id", *order]
    ranged = lines.repartitionByRange(files, *keys) if files else lines.repartitionByRange(*keys)
    (
        ranged.sortWithinPartitions(*keys)
        .select("repo_id", F.col("line").alias("value"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").text(location)
    )


def load_text(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.option("basePath", location).text(location)


def load_lines(spark: SparkSession, location: str) -> DataFrame:
    """``(repo_id, line_no, line)`` of texts written by :func:`save_text`, lines numbered from 1 in the order of the files.

    A line's number is its rank in its part file plus the lines of the part files before; only those counts meet.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    read = load_text(spark, location).select("repo_id", F.col("_metadata.file_name").alias("file"), at.alias("at"), F.col("value").alias("line"))
    files = read.groupBy("repo_id", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("repo_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("repo_id", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = read.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", "file").orderBy("at")))
    return inside.join(starts, ["repo_id", "file"]).select("repo_id", (F.col("start") + F.col("rank")).alias("line_no"), "line")
