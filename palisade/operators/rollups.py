"""Rollups over a file table: extensions, languages, directories, repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, paths as P
from ..functions.ordering import first_per_group, with_position


def _scanned_for_language(path: str = "path") -> Column:
    """Visible files outside tool folders (substring test on the directory part)."""
    hidden = F.startswith(P.basename(path), F.lit("."))
    return ~hidden & ~P.contains_any(P.dirname(path), K.LANGUAGE_SCAN_SKIP)


def extension_counts(files: DataFrame) -> DataFrame:
    """``(repo_id, ext, files)`` with ext '' for files that have none."""
    return files.groupBy("repo_id", P.extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def extension_histogram(files: DataFrame) -> DataFrame:
    """Files per extension and their share of all scanned files of the repository."""
    counts = extension_counts(files.filter(_scanned_for_language()))
    totals = counts.groupBy("repo_id").agg(F.sum("files").alias("total"))
    return (
        counts.filter(F.col("ext") != "")
        .join(totals, "repo_id")
        .withColumn("percentage", F.col("files") * 100.0 / F.col("total"))
        .drop("total")
        .withColumn("language", F.coalesce(P.grammar_language("ext"), F.lit("unknown")))
    )


def top_extensions(counts: DataFrame, limit: int) -> DataFrame:
    """Most common extensions of each repository, for display."""
    return first_per_group(
        counts.filter(F.col("ext") != ""), ["repo_id"], [F.desc("files"), F.asc("ext")], limit
    )


def primary_language(files: DataFrame) -> DataFrame:
    """Grammar language of the most frequent extension that has one; ties by extension."""
    counts = extension_counts(files.withColumn("path", F.when(_scanned_for_language(), F.col("path"))))
    language = P.grammar_language("ext")
    best = F.min(F.when(language.isNotNull(), F.struct(-F.col("files"), "ext", language.alias("language"))))
    return counts.groupBy("repo_id").agg(
        F.coalesce(best["language"], F.lit(K.DEFAULT_LANGUAGE)).alias("primary_language")
    )


def dominant_language(files: DataFrame) -> DataFrame:
    """Display language of the most frequent extension; null when no file has one."""
    best = F.min(F.when(F.col("ext") != "", F.struct(-F.col("files"), "ext")))
    return (
        extension_counts(files)
        .groupBy("repo_id")
        .agg(best["ext"].alias("ext"))
        .select("repo_id", F.when(F.col("ext").isNotNull(), P.display_language("ext")).alias("dominant_language"))
    )


def _stack_entry() -> Column:
    return F.concat("ext", F.lit(" ("), "files", F.lit(" files)"))


def stack_entries(files: DataFrame) -> DataFrame:
    """Every extension of a repository as a ``.py (3 files)`` row, in (files desc, ext) order when sorted."""
    counts = extension_counts(files).filter(F.col("ext") != "")
    return counts.select("repo_id", "ext", "files", _stack_entry().alias("entry"))


def tech_stack(files: DataFrame, top: int = 3) -> DataFrame:
    """Top extensions of a repository on one line."""
    counts = extension_counts(files)
    shown = first_per_group(
        counts.filter(F.col("ext") != ""), ["repo_id"], [F.desc("files"), F.asc("ext")], top
    )
    lines = shown.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", _stack_entry().alias("entry")))).alias("entries")
    )
    text = F.array_join(F.transform("entries", lambda e: e["entry"]), ", ")
    return (
        counts.select("repo_id").distinct()
        .join(lines, "repo_id", "left")
        .select("repo_id", F.coalesce(text, F.lit(K.UNKNOWN_STACK)).alias("tech_stack"))
    )


def architecture_pattern(files: DataFrame) -> DataFrame:
    ext = P.extension("path")
    pattern = (
        F.when(F.bool_or(ext == ".php"), "PHP Web Application")
        .when(F.bool_or(ext == ".py"), "Python Application")
        .when(F.bool_or(ext.isin(".js", ".jsx", ".ts")), "JavaScript/TypeScript Application")
        .otherwise("Unknown")
    )
    return files.groupBy("repo_id").agg(pattern.alias("architecture_pattern"))


def extension_boundaries(components: DataFrame, most: int | None = None) -> DataFrame:
    """Fallback boundaries: the files of each well-known extension, the first ``most`` if asked."""
    suffix = F.regexp_extract("path", r"(\.php|\.py|\.js)$", 1)
    fitting = components.withColumn("ext", suffix).filter(F.col("ext").isin(K.EXTENSION_BOUNDARIES))
    ranked = with_position(fitting, ["repo_id", "ext"], "ord", "rank")
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select(
        "repo_id",
        F.concat(F.upper(F.substring("ext", 2, 10)), F.lit(" Components")).alias("boundary"),
        F.concat(F.lit("Automatically detected boundary for "), "ext", F.lit(" files")).alias("description"),
        F.col("rank").cast("long").alias("position"),
        "path",
    )


def directories(components: DataFrame) -> DataFrame:
    """Files, languages and entry points of every directory."""
    return components.groupBy("repo_id", P.dirname("path").alias("directory")).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.array_sort(F.collect_set("type")).alias("languages"),
        F.bool_or("is_entry_point").alias("contains_entry_point"),
    )


def key_directories(components: DataFrame) -> DataFrame:
    """Directories of more than one file that hold an entry point or a telling name."""
    telling = P.contains_any(F.lower("directory"), K.KEY_DIRECTORY_WORDS)
    return directories(components).filter((F.col("file_count") > 1) & (F.col("contains_entry_point") | telling))


def unique_files(files: DataFrame) -> DataFrame:
    """Distinct slash-normalised paths; sort at the point of use with ``orderBy``."""
    return files.select("repo_id", P.normalise("path").alias("path")).filter(F.col("path") != "").distinct()


def repo_validity(files: DataFrame) -> DataFrame:
    """Whether a repository has content and a well-known top-level name.

    A path whose first segment is ``.git`` counts as an indicator but not as content.
    """
    top = F.substring_index("path", "/", 1)
    content = ~((top == ".git") & F.contains("path", F.lit("/")))
    return files.groupBy("repo_id").agg(
        F.count(F.when(content, 1)).alias("files"),
        F.bool_or(content).alias("is_valid"),
        F.bool_or(top.isin(K.REPO_INDICATORS)).alias("has_indicator"),
    )
