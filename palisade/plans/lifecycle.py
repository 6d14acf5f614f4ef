"""End-to-end jobs: analyze a corpus, build its threat model, report and visualize.

Every step is a table.  Model inference happens outside: ``analyze`` leaves a
question table for it, ``threat_model`` takes the answers as a response table.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import session
from ..functions.ordering import with_position
from ..operators import drawing as D, graph as G, prompts as Q, report as Rp, responses as A, risk as Rk, rollups as R
from ..operators import select as S, structure as T
from ..sources import corpus, results
from ..streaming import ingest


@dataclass(frozen=True)
class Analysis:
    """Analysis results of all repositories of a corpus."""

    components: DataFrame
    data_flows: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    critical_files: DataFrame
    file_types: DataFrame
    dominant_language: DataFrame
    key_directories: DataFrame
    tech_stack: DataFrame
    chunks: DataFrame


@dataclass(frozen=True)
class ThreatModel:
    """Normalised threat model of all repositories."""

    boundaries: DataFrame
    members: DataFrame
    flows: DataFrame
    cross_flows: DataFrame
    threats: DataFrame
    vulnerabilities: DataFrame
    risk: DataFrame


def analyze(files: DataFrame, store: ingest.ChunkStore | None = None, primary_only: bool = False) -> Analysis:
    """Scan, parse and index a ``files`` table.

    Contents are read twice at most: once for the structure, which is staged,
    and once for the chunks of files that ``store`` does not hold yet.
    """
    accepted = corpus.filter_files(files)
    paths = accepted.select("repo_id", "path", "ord")
    primary = R.primary_language(paths) if primary_only else None
    parsed = session.stage(T.components(accepted, primary).drop("content"), "components")
    critical = S.critical_files(parsed)
    spark = files.sparkSession
    kept = store or ingest.open_store(spark, session.scratch_path(spark, "chunks"))
    ingest.ingest_batch(kept, accepted)
    return Analysis(
        components=S.flag_critical(parsed),
        data_flows=T.data_flows(parsed),
        edges=T.import_edges(parsed, paths).unionByName(
            T.dependency_edges(parsed).select(
                "repo_id", "src_path", F.col("dep_pos").alias("import_pos"), "dst_path"
            )
        ),
        entry_points=parsed.filter("is_entry_point").select("repo_id", "path", "ord"),
        critical_files=critical,
        file_types=R.extension_counts(paths),
        dominant_language=R.dominant_language(paths),
        key_directories=R.key_directories(parsed),
        tech_stack=R.tech_stack(paths),
        chunks=kept.load(),
    )


def exploration_prompts(analysis: Analysis, purposes: DataFrame) -> DataFrame:
    """Questions about the selected components, ready for batched retrieval."""
    chosen = S.priority_components(analysis.components).join(purposes, ["repo_id", "path"], "left")
    return Q.component_questions(chosen).withColumn("query", F.concat_ws(" ", "path", "question"))


def threat_model(analysis: Analysis, boundary_answers: DataFrame, threat_answers: DataFrame,
                 vulnerability_answers: DataFrame) -> ThreatModel:
    """Combine model answers with the analysis.

    ``boundary_answers(repo_id, response_id, text)``, ``threat_answers(repo_id,
    owner_kind, owner, text)``, ``vulnerability_answers(repo_id, response_id, text)``.
    """
    merged = A.merge_boundaries(A.boundary_lines(boundary_answers))
    members = A.merge_members(A.boundary_member_lines(boundary_answers), merged)
    fallback = A.default_boundary(analysis.components, merged)
    placed = members.select("repo_id", "boundary", "member", F.col("response_id").alias("ord")).unionByName(
        fallback.select("repo_id", "boundary", "member", F.lit(0).cast("long").alias("ord"))
    )
    boundaries = merged.select("repo_id", "boundary", "description").unionByName(
        fallback.select("repo_id", "boundary", "description").distinct()
    )
    relations = analysis.edges.select("repo_id", F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    named = analysis.data_flows.select(
        "repo_id", F.col("path").alias("source"), F.col("path").alias("component"), "function", "parameters", "ord"
    )
    flows = Rk.flow_flags(named, relations, placed)
    cross = Rk.cross_boundary_flows(named, relations, placed)
    crossing = flows.select("repo_id", F.col("source").alias("owner"), "crosses_boundary").distinct()
    threats = (
        A.threat_rows(threat_answers)
        .join(crossing, ["repo_id", "owner"], "left")
        .withColumn("crosses_boundary", F.coalesce("crosses_boundary", F.lit(False)))
    )
    vulns = A.vulnerability_rows(vulnerability_answers)
    scored = threats.select("repo_id", "owner_kind", "severity", "crosses_boundary").unionByName(
        vulns.select("repo_id", F.lit("vulnerability").alias("owner_kind"), "severity",
                     F.lit(False).alias("crosses_boundary"))
    )
    return ThreatModel(boundaries, placed, flows, cross, threats, vulns, Rk.overall_risk(scored, analysis.components))


def save_model(spark: SparkSession, model: ThreatModel, location: str) -> None:
    """The whole model, boundaries, members, flows, crossings, threats, vulnerabilities and risk, as JSON tables."""
    results.save_tables(spark, {f.name: getattr(model, f.name) for f in fields(ThreatModel)}, location)


def load_model(spark: SparkSession, location: str) -> ThreatModel:
    return ThreatModel(**results.load_tables(spark, location, [f.name for f in fields(ThreatModel)]))


def owners(analysis: Analysis) -> DataFrame:
    """Report owners: every component and every (source -> function) flow."""
    comps = analysis.components.select(
        "repo_id", F.lit("component").alias("owner_kind"), F.col("path").alias("owner"), F.col("type").alias("owner_type")
    )
    flows = analysis.data_flows.select(
        "repo_id", F.lit("flow").alias("owner_kind"), F.col("path").alias("owner"),
        F.lit(None).cast("string").alias("owner_type"),
    ).distinct()
    return comps.unionByName(flows)


def save_report(analysis: Analysis, model: ThreatModel, location: str, date: str = "") -> None:
    """Findings, recommendations and risk as ordered Markdown lines per repository."""
    found = Rp.findings(owners(analysis), model.threats)
    lines = Rp.report_lines(found, Rp.recommendations(model.threats), model.risk, date)
    results.save_text(lines, location, ["section", "owner", "ord", "step"])


def save_component_diagrams(comps: DataFrame, data_flows: DataFrame, location: str) -> None:
    """Class and flow diagrams of every repository as ordered text."""
    order = ["section", "ord", "step"]
    results.save_text(G.class_diagram_lines(comps), f"{location}/class_diagram", order)
    results.save_text(G.flow_diagram_lines(comps, data_flows), f"{location}/flow_diagram", order)


def threat_lines(analysis: Analysis, model: ThreatModel) -> DataFrame:
    """The threat diagram of a model: priority components, flows, crossings, threats and vulnerabilities around its boundaries."""
    comps = analysis.components.select("repo_id", F.col("path").alias("name"), S.is_priority().alias("is_priority"), "ord")
    listed = model.members.groupBy("repo_id", "boundary").agg(F.min("ord").alias("ord"))
    bounds = model.boundaries.join(listed, ["repo_id", "boundary"], "left").withColumn("ord", F.coalesce("ord", F.lit(D.LAST)))
    # Answers number their vulnerabilities from 0; a diagram numbers those of all answers.
    vulns = with_position(model.vulnerabilities.withColumnRenamed("ordinal", "at"), ["repo_id"], "response_id", "ordinal", then=["at"])
    return D.threat_drawing(bounds, model.members, comps, model.flows, model.cross_flows, model.threats, vulns, analysis.components)


def save_diagrams(analysis: Analysis, location: str, model: ThreatModel | None = None) -> None:
    """Class and flow diagrams of every repository as ordered text, and the threat diagram if there is a model."""
    save_component_diagrams(analysis.components, analysis.data_flows, location)
    if model is not None:
        results.save_text(threat_lines(analysis, model), f"{location}/threat_diagram", [*D.PLACE, "line"])


def report_from_saved(spark: SparkSession, model_location: str, location: str, stacks: DataFrame | None = None) -> None:
    """Report of a saved threat model; an empty one when nothing was saved."""
    saved = results.load_threat_model(spark, model_location, stacks)
    threats = results.model_threats(saved)
    risk = saved.select("repo_id", "overall_risk").distinct()
    named = saved.filter(F.col("owner").isNotNull()).select("repo_id", "owner_kind", "owner").distinct()
    lines = Rp.report_lines(Rp.findings(named, threats), Rp.recommendations(threats), risk)
    results.save_text(lines, location, ["section", "owner", "ord", "step"])
