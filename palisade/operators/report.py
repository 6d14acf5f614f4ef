"""Findings, recommendations and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_UNKNOWN = "Unknown"


def findings(owners: DataFrame, threats: DataFrame) -> DataFrame:
    """One row per (owner, threat) with report defaults; owners without threats keep a row.

    ``owners(repo_id, owner_kind, owner[, owner_type])``.
    """
    marked = threats.withColumn("__hit", F.lit(True))
    joined = owners.join(marked, ["repo_id", "owner_kind", "owner"], "left")

    def field(name: str, default: str) -> Column:
        return F.when(F.col("__hit"), F.coalesce(name, F.lit(default))).alias(name)

    extra = [c for c in ("owner_type",) if c in owners.columns]
    return joined.select(
        "repo_id", "owner_kind", "owner", *[F.coalesce(c, F.lit(_UNKNOWN)).alias(c) for c in extra], "ordinal",
        field("type", _UNKNOWN), field("description", "No description"), field("severity", _UNKNOWN),
        field("impact", _UNKNOWN), field("mitigation", _UNKNOWN), "code_snippet",
    )


def recommendations(threats: DataFrame) -> DataFrame:
    """An action per component or flow threat of severity exactly High or Medium.

    ``(priority_order, kind_order, owner, ordinal)`` is the order of the list.
    """
    kinds = F.col("owner_kind").isin("component", "flow")
    is_flow = F.col("owner_kind") == "flow"
    text = F.concat(
        F.lit("Address "), F.coalesce("type", F.lit(_UNKNOWN)), F.lit(" threat: "),
        F.coalesce("description", F.lit("No description")),
    )
    return threats.filter(kinds & F.col("severity").isin("High", "Medium")).select(
        "repo_id",
        F.when(is_flow, "Data Flow").otherwise("Component").alias("type"),
        F.coalesce("owner", F.lit(_UNKNOWN)).alias("target"),
        text.alias("description"),
        F.col("severity").alias("priority"),
        F.coalesce("mitigation", F.lit("No mitigation provided")).alias("action"),
        F.when(F.col("severity") == "High", 0).otherwise(1).alias("priority_order"),
        F.when(is_flow, 1).otherwise(0).alias("kind_order"),
        "ordinal",
    )


def _line(section: Column | int, owner: Column | str, ordinal: Column | int, step: int, text: Column) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    name = F.lit(owner) if isinstance(owner, str) else owner
    return F.struct(
        lit(section).cast("int").alias("section"), name.alias("owner"), lit(ordinal).cast("long").alias("ord"),
        F.lit(step).alias("step"), text.alias("line"),
    )


def _fixed(repos: DataFrame, section: int, lines: list[str]) -> DataFrame:
    rows = F.array(*[_line(section, "", -1, i, F.lit(t)) for i, t in enumerate(lines)])
    return repos.select("repo_id", F.inline(rows))


def report_lines(findings_: DataFrame, recs: DataFrame, risk: DataFrame, date: str = "") -> DataFrame:
    """The report as rows ``(repo_id, section, owner, ord, step, line)``, sorted by those keys when written."""
    head = F.array(
        *[
            _line(0, "", -1, i, t)
            for i, t in enumerate(
                [
                    F.lit("# Security Threat Analysis Report"), F.lit(""), F.lit(f"**Date:** {date}"), F.lit(""),
                    F.lit("## Overview"), F.lit(""),
                    F.lit(
                        "This report presents the security analysis of the codebase, including identified threats, "
                        "risk assessment, and recommendations."
                    ),
                    F.lit(""), F.lit("## Risk Assessment"), F.lit(""),
                    F.concat(F.lit("**Overall Risk Level:** "), "overall_risk"), F.lit(""),
                ]
            )
        ]
    )
    repos = risk.select("repo_id")
    kinds = {"component": 1, "flow": 2, "vulnerability": 3}
    section = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("owner_kind")]
    heading = F.concat(
        F.lit("### "), "owner",
        F.when(F.col("owner_kind") == "component", F.concat(F.lit(" ("), "owner_type", F.lit(")"))).otherwise("")
        if "owner_type" in findings_.columns else F.lit(""),
    )
    none = F.col("severity").isNull()
    owners = (
        findings_.groupBy("repo_id", "owner_kind", "owner", *(["owner_type"] if "owner_type" in findings_.columns else []))
        .agg(F.bool_and(none).alias("empty"))
        .select(
            "repo_id",
            F.inline(
                F.array(
                    _line(section, F.col("owner"), -1, 0, heading),
                    _line(
                        section, F.col("owner"), -1, 1,
                        F.when(F.col("empty"), "No threats identified.").otherwise("#### Identified Threats"),
                    ),
                )
            ),
        )
    )
    fields = ["type", "severity", "description", "impact", "mitigation"]
    items = [
        _line(section, F.col("owner"), F.col("ordinal"), i, F.concat(F.lit(f"- **{f.capitalize()}:** "), f))
        for i, f in enumerate(fields)
    ]
    snippet = _line(
        section, F.col("owner"), F.col("ordinal"), len(fields),
        F.concat(F.lit("```python\n"), "code_snippet", F.lit("\n```")),
    )
    # The snippet row is only emitted where the threat has one.
    rows = F.filter(F.array(*items, snippet), lambda r: r["line"].isNotNull())
    threats = findings_.filter(~none).select("repo_id", F.inline(rows))
    with_vulns = findings_.filter("owner_kind = 'vulnerability'").select("repo_id").distinct()
    rec_order = F.lpad((F.col("priority_order") * 2 + F.col("kind_order")).cast("string"), 2, "0")
    rec_key = F.concat(rec_order, F.lit("|"), "target")
    rec_lines = recs.select(
        "repo_id",
        F.inline(
            F.array(
                _line(5, rec_key, F.col("ordinal"), 0, F.concat(F.lit("### "), "type", F.lit(": "), "target")),
                _line(5, rec_key, F.col("ordinal"), 1, F.concat(F.lit("- **Priority:** "), "priority")),
                _line(5, rec_key, F.col("ordinal"), 2, F.concat(F.lit("- **Description:** "), "description")),
                _line(5, rec_key, F.col("ordinal"), 3, F.concat(F.lit("- **Action:** "), "action")),
            )
        ),
    )
    return (
        risk.select("repo_id", F.inline(head))
        .unionByName(_fixed(repos, 1, ["## Components Analysis", ""]))
        .unionByName(_fixed(repos, 2, ["## Data Flow Analysis", ""]))
        .unionByName(_fixed(with_vulns, 3, ["", "## Vulnerability Analysis", ""]))
        .unionByName(owners)
        .unionByName(threats)
        .unionByName(_fixed(repos, 4, ["", "## Recommendations", ""]))
        .unionByName(rec_lines)
    )
