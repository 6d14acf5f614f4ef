"""Typed rows from free-text model answers.

A response is parsed inside its row: its lines are grouped with array slices at
computed cut positions, so no line is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import constants as K, text as X
from ..functions.ordering import with_position
from . import rollups as R


def _key(line: Column) -> Column:
    """Normalised text before the first colon; null for lines without one."""
    raw = F.lower(X.strip(F.substring_index(line, ":", 1)))
    return F.when(F.contains(line, F.lit(":")), F.replace(raw, F.lit(" "), F.lit("_")))


def _value(line: Column) -> Column:
    return X.strip(line.substr(F.locate(":", line) + 1, F.length(line)))


def _records(text: Column, strip_bullets: bool) -> Column:
    """Lines of each threat record.

    A blank line closes a record only once the record has a ``type``; blocks
    without one run on into the next.  The cut positions are therefore the ends
    of the blocks that contain a type line.
    """

    def clean(line: Column) -> Column:
        line = X.strip(line)
        return F.regexp_replace(line, r"^[-*]\s+", "") if strip_bullets else line

    lines = F.transform(F.split(text, "\n", -1), clean)
    # A sentinel blank line closes the record that ends with the text.
    closed = F.concat(lines, F.array(F.lit("")))
    return _bind(closed, _cut_records)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut_records(lines: Column) -> Column:
    marks = F.transform(
        lines, lambda s, i: F.when(s == "", i + 1).when(_key(s) == "type", -(i + 1))
    )
    events = F.filter(marks, lambda m: m.isNotNull())  # blank lines > 0, type lines < 0

    # Blanks whose previous event is a type line close a record; a run of type
    # lines is one event, and later blanks follow a blank.
    ends = lambda ev: F.filter(
        F.transform(ev, lambda m, i: F.when((m > 0) & (F.get(ev, i - 1) < 0), m)), lambda m: m.isNotNull()
    )
    slices = lambda cuts: F.transform(
        cuts,
        lambda c, j: F.filter(
            F.slice(lines, F.coalesce(F.get(cuts, j - 1), F.lit(0)) + 1, c - F.coalesce(F.get(cuts, j - 1), F.lit(0))),
            lambda s: s != "",
        ),
    )
    return _bind(_bind(events, ends), slices)


def threat_rows(responses: DataFrame, strip_bullets: bool = False) -> DataFrame:
    """Threat records of ``responses(response_id, text, ...)`` with normalised severity."""

    kept = [c for c in responses.columns if c != "text"]
    rows = responses.select(*kept, F.posexplode(_records(F.col("text"), strip_bullets)).alias("ordinal", "__r"))

    def cell(name: str) -> Column:
        hits = F.filter("__r", lambda s: _key(s) == name)
        value = _value(F.get(hits, F.size(hits) - 1))
        return value if name == "code_snippet" else F.coalesce(value, F.lit(K.MISSING_FIELD))

    return (
        rows.select(*kept, F.col("ordinal").cast("long").alias("ordinal"), *[cell(f).alias(f) for f in K.THREAT_FIELDS])
        .withColumn("severity", X.normalise_severity("severity"))
    )


def analysis_rows(responses: DataFrame) -> DataFrame:
    """Purpose, functions, dependencies and considerations of a component answer."""
    kept = [c for c in responses.columns if c != "text"]
    return responses.select(
        *kept,
        X.section("text", "Purpose").alias("purpose"),
        X.section_list("text", "Key Functions").alias("key_functions"),
        X.section_list("text", "Dependencies").alias("dependencies"),
        X.section_list("text", "Security Considerations").alias("security_considerations"),
    )


def _named_lines(name: str) -> Column:
    """``- key: value`` lines of a section as array<struct<name,value>>."""
    lines = F.transform(F.split(X.section("text", name), "\n", -1), X.strip)
    bulleted = F.filter(lines, lambda s: F.startswith(s, F.lit("- ")) & F.contains(s, F.lit(":")))
    return F.transform(
        bulleted,
        lambda s: F.struct(
            X.strip(F.substring_index(F.substring(s, 3, 1 << 30), ":", 1)).alias("name"), _value(s).alias("value")
        ),
    )


def boundary_lines(responses: DataFrame) -> DataFrame:
    """``(repo_id, response_id, pos, boundary, description)`` of every response."""
    return responses.select(
        "repo_id", "response_id", F.posexplode(_named_lines("SECURITY_BOUNDARIES")).alias("pos", "b")
    ).select("repo_id", "response_id", "pos", F.col("b.name").alias("boundary"), F.col("b.value").alias("description"))


def boundary_member_lines(responses: DataFrame) -> DataFrame:
    """``(repo_id, response_id, pos, boundary, member)``, before the known-name check."""
    named = responses.select(
        "repo_id", "response_id", F.posexplode(_named_lines("FILES_BY_BOUNDARY")).alias("line", "b")
    )
    return named.select(
        "repo_id", "response_id", F.col("b.name").alias("boundary"), "line",
        F.posexplode(F.split("b.value", ",", -1)).alias("at", "member"),
    ).select(
        "repo_id", "response_id", (F.col("line") * 1_000_000 + F.col("at")).cast("long").alias("pos"),
        "boundary", X.strip("member").alias("member"),
    ).filter(F.col("member") != "")


def merge_boundaries(lines: DataFrame) -> DataFrame:
    """Union of boundary names; the longest description wins, the earlier one on ties."""
    order = F.struct("response_id", "pos")
    return lines.groupBy("repo_id", "boundary").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("response_id"), -F.col("pos"))).alias(
            "description"
        ),
        F.min(order)["response_id"].alias("first_response"),
        F.min(order)["pos"].cast("long").alias("first_pos"),
    )


def merge_members(lines: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Distinct members of boundaries already named when the member was listed, with their first place."""
    known = boundaries.select("repo_id", "boundary", "first_response")
    return (
        lines.join(known, ["repo_id", "boundary"])
        .filter(F.col("first_response") <= F.col("response_id"))
        .groupBy("repo_id", "boundary", "member")
        .agg(F.min(F.struct("response_id", "pos")).alias("o"))
        .select(
            "repo_id", "boundary", "member", F.col("o.response_id").alias("response_id"), F.col("o.pos").alias("pos")
        )
    )


def architecture_description(responses: DataFrame) -> DataFrame:
    """Last meaningful description (over 10 characters), else the first non-empty one."""
    text = X.section("text", "DESCRIPTION")
    return (
        responses.select("repo_id", "response_id", text.alias("d"))
        .filter(F.col("d") != "")
        .groupBy("repo_id")
        .agg(
            F.coalesce(
                F.max_by(F.when(F.length("d") > 10, F.col("d")), F.when(F.length("d") > 10, F.col("response_id"))),
                F.min_by("d", "response_id"),
            ).alias("description")
        )
    )


def vulnerability_rows(responses: DataFrame) -> DataFrame:
    """Vulnerabilities of JSON answers; an answer that is not valid JSON yields nothing."""
    kept = [c for c in responses.columns if c != "text"]
    parsed = F.from_json(X.json_array("text"), "array<" + schemas.VULNERABILITY.simpleString() + ">")
    return responses.select(*kept, F.posexplode(parsed).alias("ordinal", "v")).select(
        *kept, F.col("ordinal").cast("long").alias("ordinal"), "v.*"
    )


def default_boundary(files: DataFrame, boundaries: DataFrame, limit: int | None = None) -> DataFrame:
    """One boundary over the files of each repository that has none, the first ``limit`` if asked."""
    missing = files.join(boundaries.select("repo_id").distinct(), "repo_id", "left_anti")
    placed = with_position(missing, ["repo_id"], "ord", "position")
    return (placed if limit is None else placed.filter(F.col("position") <= limit)).select(
        "repo_id", F.lit("Default Boundary").alias("boundary"),
        F.lit("Default security boundary for all components").alias("description"),
        F.col("position").cast("long").alias("position"), F.col("path").alias("member"),
    )


def minimal_models(files: DataFrame) -> DataFrame:
    """The model of a repository without components: no owners, unknown risk, and what its files' names tell.

    One row per extension, ``(repo_id, overall_risk, architecture_pattern, ext, entry)``; a repository without extensions
    keeps a row.
    """
    return (
        R.architecture_pattern(files)
        .join(R.stack_entries(files).drop("files"), "repo_id", "left")
        .select("repo_id", F.lit("Unknown").alias("overall_risk"), "architecture_pattern", "ext", "entry")
    )


def placeholder_threats(comps: DataFrame, flows: DataFrame) -> DataFrame:
    """The fixed threat of every component and flow when there are no model answers."""
    fields = [F.lit(v).alias(k) for k, v in K.PLACEHOLDER_THREAT.items()]
    none = F.lit(None).cast("string").alias("code_snippet")
    owners = comps.select("repo_id", F.lit("component").alias("owner_kind"), F.col("path").alias("owner")).unionByName(
        flows.select(
            "repo_id", F.lit("flow").alias("owner_kind"), F.concat("source", F.lit(" -> "), "function").alias("owner")
        )
    )
    return owners.select("repo_id", "owner_kind", "owner", F.lit(0).cast("long").alias("ordinal"), *fields, none)
