"""Selection of files and components: searches, tiers, caps and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, paths as P
from ..functions.ordering import first_per_group, with_position


def path_search(files: DataFrame, pattern: str, max_results: int | None = None) -> DataFrame:
    """Distinct paths of each repository that match, numbered in input order; the first ``max_results`` if asked."""
    hits = (
        files.filter((F.col("path") != "") & P.path_matches("path", pattern))
        .groupBy("repo_id", "path")
        .agg(F.min("ord").alias("ord"))
    )
    return limited(with_position(hits, ["repo_id"], "ord", "rank"), "rank", max_results)


def is_critical(path: Column | str = "path", entry: Column | str = "is_entry_point") -> Column:
    """Entry points, and paths that hold a security or database word."""
    return P._col(entry) | P.contains_any(P._col(path), [*K.SECURITY_WORDS, *K.DATABASE_WORDS])


def critical_files(comps: DataFrame) -> DataFrame:
    """Distinct paths of the critical files of each repository."""
    return comps.filter(is_critical()).select("repo_id", "path").distinct()


def flag_critical(comps: DataFrame) -> DataFrame:
    """Set ``is_critical``; a map over the rows, nothing else of a component changes."""
    return comps.withColumn("is_critical", is_critical())


def is_priority(name: Column | str = "name", path: Column | str = "path", entry: Column | str = "is_entry_point") -> Column:
    words = lambda c: P.contains_any(F.lower(P._col(c)), K.PRIORITY_WORDS)
    return words(name) | words(path) | P._col(entry)


def priority_components(comps: DataFrame, cap: int | None = None) -> DataFrame:
    """All components with their position: priority components first, then the others; the first ``cap`` if asked."""
    flagged = comps.withColumn("is_priority", is_priority()).withColumn("__tier", F.when(F.col("is_priority"), 0).otherwise(1))
    return limited(with_position(flagged, ["repo_id"], "ord", "position", tier="__tier").drop("__tier"), "position", cap)


def tiered_files(comps: DataFrame) -> DataFrame:
    """Analysis order: entry points, paths with security, model and API words, the rest.

    ``tier`` is 0 for entry points, 1..n for the first search word that the path holds and
    n+1 for the rest; ``(tier, ord)`` is the order of the list.
    """
    words = [w for group in K.TIER_WORDS.values() for w in group]
    first = F.get(P.matching_words("path", words), F.lit(0))["pos"] + 1
    tier = F.when(F.col("is_entry_point"), 0).otherwise(F.coalesce(first, F.lit(len(words) + 1)))
    return comps.select("repo_id", "path", "ord", "is_entry_point", tier.cast("int").alias("tier"))


def capped_files(tiered: DataFrame, cap: int | None = None) -> DataFrame:
    """Files of the architecture analysis in tiered order, test paths dropped; the first ``cap`` per repository if asked.

    Positions come from range counts, so no whole repository is sorted in one task.
    """
    files = tiered.filter(~P.is_test_path("path"))
    placed = with_position(files, ["repo_id"], "ord", "position", tier="tier")
    return limited(placed, "position", cap).select("repo_id", "path", "ord", "tier", "position")


def limited(df: DataFrame, position: str, most: int | None) -> DataFrame:
    """Rows up to a position, all of them where no limit is asked for."""
    return df if most is None else df.filter(F.col(position) <= most)


def restricted_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose two ends are both in the file list; test paths removed."""
    keep = files.select("repo_id", "path").distinct()
    ends = edges.filter(~P.is_test_path("src_path") & ~P.is_test_path("dst_path"))
    return ends.join(
        keep.withColumnRenamed("path", "src_path"), ["repo_id", "src_path"], "left_semi"
    ).join(keep.withColumnRenamed("path", "dst_path"), ["repo_id", "dst_path"], "left_semi")


def not_indexed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose normalised path is not in the index yet (idempotent ingest)."""
    seen = indexed.select("repo_id", P.normalise("path").alias("__norm")).distinct()
    return (
        files.withColumn("__norm", P.normalise("path"))
        .join(seen, ["repo_id", "__norm"], "left_anti")
        .drop("__norm")
    )


def best_related(edges: DataFrame) -> DataFrame:
    """First related file with the source's extension, else the first related file."""
    other = P.extension("src_path") != P.extension("dst_path")
    return edges.groupBy("repo_id", "src_path").agg(
        F.min_by("dst_path", F.struct(other, "ord", "dst_path")).alias("dst_path"),
        F.count(F.lit(1)).alias("related"),
    )


def restricted_halves(deps: DataFrame, hits: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The halves of the dependency relation over the files of a list, test paths removed, before any pair is made."""
    keep = files.filter(~P.is_test_path("path")).select("repo_id", "path").distinct()
    return (
        deps.join(keep.withColumnRenamed("path", "src_path"), ["repo_id", "src_path"], "left_semi"),
        hits.join(keep.withColumnRenamed("path", "dst_path"), ["repo_id", "dst_path"], "left_semi"),
    )


ANY = "*"  # no extension, for those begin with a dot


def best_of_dependencies(deps: DataFrame, hits: DataFrame, files: DataFrame) -> DataFrame:
    """:func:`best_related` of the dependency relation, made from its halves without the pairs of files.

    ``files(repo_id, path, ord[, module_name])`` has every path once.  A dependency
    keeps its two first files of each extension and of all, two because one of them may be the
    asking file itself; a source looks at four candidates a dependency, however many files that names.
    """
    itself = F.contains("src_path", F.col("dep"))
    own = files.select("repo_id", F.col("path").alias("src_path"), *(["module_name"] if "module_name" in files.columns else []))
    placed = hits.join(files.select("repo_id", F.col("path").alias("dst_path"), "ord"), ["repo_id", "dst_path"])
    if "module_name" in files.columns:
        deps = deps.join(own, ["repo_id", "src_path"])
        itself = itself | F.coalesce(F.col("module_name") == F.col("dep"), F.lit(False))
    both = placed.withColumn("want", F.explode(F.array(P.extension("dst_path"), F.lit(ANY))))
    firsts = first_per_group(both, ["repo_id", "dep", "want"], [F.asc("ord"), F.asc("dst_path")], 2).drop("rank")
    named = hits.groupBy("repo_id", "dep").agg(F.count(F.lit(1)).alias("n"))
    counts = deps.join(named, ["repo_id", "dep"]).groupBy("repo_id", "src_path").agg(
        F.sum(F.col("n") - itself.cast("long")).alias("related")
    )
    asked = deps.select("repo_id", "src_path", "dep", F.explode(F.array(P.extension("src_path"), F.lit(ANY))).alias("want"))
    found = asked.join(firsts, ["repo_id", "dep", "want"]).filter(F.col("src_path") != F.col("dst_path"))
    other = P.extension("src_path") != P.extension("dst_path")
    best = found.groupBy("repo_id", "src_path").agg(F.min_by("dst_path", F.struct(other, "ord", "dst_path")).alias("dst_path"))
    return best.join(counts, ["repo_id", "src_path"])
