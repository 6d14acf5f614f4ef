"""Boundary crossings, risk scores and threat rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.ordering import first_per_group


def member_boundaries(members: DataFrame) -> DataFrame:
    """One boundary per member; a later one replaces an earlier one."""
    keys = [c for c in ["repo_id", "member"] if c in members.columns]
    last = F.max_by("boundary", "ord") if "ord" in members.columns else F.max("boundary")
    return members.groupBy(*keys).agg(last.alias("boundary"))


def _base(source: Column | str) -> Column:
    """The component of a source: the part before the first dot."""
    return F.substring_index(source, ".", 1)


def _ends(flows: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and relations with the boundaries of their members: ``(repo_id, source, base, source_boundary)``, ``(repo_id, base, destination, destination_boundary)``."""
    bounds = member_boundaries(members)
    shared = [c for c in ["repo_id"] if c in bounds.columns]
    component = F.col("component") if "component" in flows.columns else _base("source")
    usable = flows.filter((F.col("source") != "") & (F.col("function") != ""))
    sources = usable.select("repo_id", "source", component.alias("base")).distinct()
    placed = sources.join(
        bounds.select(*shared, F.col("member").alias("source"), F.col("boundary").alias("source_boundary")),
        [*shared, "source"],
    )
    targets = edges.join(
        bounds.select(*shared, F.col("member").alias("dst"), F.col("boundary").alias("destination_boundary")),
        [*shared, "dst"],
    ).select("repo_id", F.col("src").alias("base"), F.col("dst").alias("destination"), "destination_boundary")
    return placed, targets


def crossing_sources(flows: DataFrame, edges: DataFrame, members: DataFrame, repeated: bool = False) -> DataFrame:
    """``(repo_id, source, source_boundary, destination, destination_boundary)``.

    Works on distinct sources: a crossing depends on the source only, so flows
    are aggregated away before anything is joined.  Relations are looked up by
    the flow's ``component`` if there is such a column, else by the part of the
    source before the first dot.  Where ``edges`` may list a relation
    ``repeated``, it counts once; that is told after the join with the boundaries, by whose key the rows lie already.
    """
    placed, targets = _ends(flows, edges, members)
    return (
        placed.join(targets.distinct() if repeated else targets, ["repo_id", "base"])
        .filter(F.col("source_boundary") != F.col("destination_boundary"))
        .drop("base")
    )


def crossing_marks(flows: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``(repo_id, source)`` of all crossings: a source needs the boundaries that it reaches, not the members in them."""
    placed, targets = _ends(flows, edges, members)
    reached = targets.select("repo_id", "base", "destination_boundary").distinct()
    found = placed.alias("p").join(
        reached.alias("t"),
        (F.col("p.repo_id") == F.col("t.repo_id")) & (F.col("p.base") == F.col("t.base")) & (F.col("p.source_boundary") != F.col("t.destination_boundary")),
        "left_semi",
    ).select("repo_id", "source")
    return found.distinct() if "component" in flows.columns else found


def cross_boundary_flows(flows: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Flows whose source relates to a member of another boundary, one row per relation."""
    crossing = crossing_sources(flows, edges, members)
    return flows.filter(F.col("function") != "").join(crossing, ["repo_id", "source"])


def flow_flags(flows: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Flag all flows of a source as soon as one of them crosses a boundary.

    Only the existence of a crossing matters, so neither the flow x destination
    pairs nor a window over a source's flows are built.
    """
    return flag_sources(flows, crossing_marks(flows, edges, members), once=True)


def flag_sources(flows: DataFrame, crossing: DataFrame, once: bool = False) -> DataFrame:
    """Flag the flows of all sources of a crossing table, which may hold a source only ``once``."""
    marks = crossing.select("repo_id", "source")
    flagged = (marks if once else marks.distinct()).withColumn("__x", F.lit(True))
    return (
        flows.join(flagged, ["repo_id", "source"], "left")
        .withColumn("crosses_boundary", F.coalesce("__x", F.lit(False)))
        .drop("__x")
    )


def severity_score(severity: Column | str, normalize_case: bool = False) -> Column:
    sev = F.col(severity) if isinstance(severity, str) else severity
    sev = F.initcap(sev) if normalize_case else sev
    score = F.lit(1.0)
    for name, value in K.SEVERITY_SCORE.items():
        score = F.when(sev == name, float(value)).otherwise(score)
    return score


def overall_risk(threats: DataFrame, repos: DataFrame | None = None, normalize_case: bool = False) -> DataFrame:
    """Risk level per repository from weighted severities; repositories without threats are Low.

    One map-side combined aggregate; the weight depends on the owner kind and,
    for flows, on whether they cross a boundary.
    """
    weight = (
        F.when((F.col("owner_kind") == "flow") & F.coalesce("crosses_boundary", F.lit(False)), K.CROSSING_WEIGHT)
        .when(F.col("owner_kind") == "vulnerability", K.VULNERABILITY_WEIGHT)
        .otherwise(1.0)
    )
    score = severity_score(F.coalesce("severity", F.lit("Low")), normalize_case) * weight
    scored = threats.groupBy("repo_id").agg(
        F.max(score).alias("max_score"), F.sum(score).alias("total"), F.count(F.lit(1)).alias("threats")
    )
    if repos is not None:
        scored = repos.select("repo_id").distinct().join(scored, "repo_id", "left")
    top, avg = F.coalesce("max_score", F.lit(0.0)), F.coalesce(F.col("total") / F.col("threats"), F.lit(0.0))
    level = (
        F.when((top >= 3) | (avg >= 2.0), "High").when((top >= 2) | (avg >= 1.5), "Medium").otherwise("Low")
    )
    return scored.select(
        "repo_id", top.alias("max_score"), avg.alias("avg_score"),
        F.coalesce("threats", F.lit(0)).cast("long").alias("threats"), level.alias("overall_risk"),
    )


def high_risk_components(threats: DataFrame) -> DataFrame:
    high = (F.col("owner_kind") == "component") & (F.lower("severity") == "high")
    return threats.filter(high).select("repo_id", F.col("owner").alias("component")).distinct()


def risky_relationships(edges: DataFrame, high_risk: DataFrame, sources: int = 5, targets: int = 3) -> DataFrame:
    """First high-risk sources of a repository with their first targets on one line.

    ``edges(repo_id, src, dst, ord)``.  One target more than shown is kept per
    source, enough to know whether the list goes on.
    """
    risky = edges.join(high_risk.withColumnRenamed("component", "src"), ["repo_id", "src"], "left_semi")
    shown = first_per_group(risky, ["repo_id", "src"], [F.asc("ord"), F.asc("dst")], targets + 1)
    lists = shown.groupBy("repo_id", "src").agg(
        F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("xs")
    )
    names = F.transform(F.slice("xs", 1, targets), lambda x: x["dst"])
    line = F.concat(
        "src", F.lit(" -> "), F.array_join(names, ", "), F.when(F.size("xs") > targets, "...").otherwise("")
    )
    return first_per_group(
        lists.withColumn("line", line), ["repo_id"], [F.asc("ord"), F.asc("src")], sources, "position"
    ).select("repo_id", F.col("position").cast("long").alias("position"), F.col("src").alias("source"), "line")


def severity_bucket(severity: Column | str = "severity") -> Column:
    """Display bucket: everything that is neither high nor medium is low."""
    low = F.lower(F.col(severity) if isinstance(severity, str) else severity)
    return F.when(low == "high", "high").when(low == "medium", "medium").otherwise("low")


def threat_counts(threats: DataFrame) -> DataFrame:
    bucket = severity_bucket()
    count = lambda b: F.count(F.when(bucket == b, 1)).alias(b)
    return threats.groupBy("repo_id", "owner_kind", "owner").agg(count("high"), count("medium"), count("low"))
