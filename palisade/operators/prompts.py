"""Prompt tables: limited components, packed contexts and exploration questions.

Model inference stays outside: these tables go to it, response tables come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, paths as P, text as X
from ..functions.ordering import first_per_group, with_position


def component_parts(comps: DataFrame, classes: int = K.LIMIT_CLASSES, items: int = K.LIMIT_ITEMS, chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """A component in parts of bounded lists, numbered by ``part``: nothing of it is lost.

    Part ``p`` holds the p-th ``classes`` classes (with all their methods), the p-th ``items`` functions, imports and
    dependencies, and the p-th ``chars`` characters of ``context``; a list that is used up is empty.
    """
    sizes = {"classes": classes, "functions": items, "imports": items, "dependencies": items}
    sizes = {c: n for c, n in sizes.items() if c in comps.columns}
    lengths = [F.ceil(F.size(c) / F.lit(n)) for c, n in sizes.items()]
    if "context" in comps.columns:
        comps = comps.withColumn("context", F.coalesce("context", F.lit("")))
        lengths.append(F.ceil(F.length("context") / F.lit(chars)))
    last = F.greatest(*lengths, F.lit(1)).cast("int") - 1
    parted = comps.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    for column, n in sizes.items():
        parted = parted.withColumn(column, F.slice(column, F.col("part") * n + 1, F.lit(n)))
    if "context" in comps.columns:
        parted = parted.withColumn("context", F.substring("context", F.col("part") * chars + 1, F.lit(chars)))
    return parted


def _counted(items: Column, inner: str, unit: str) -> Column:
    lines = F.transform(
        items, lambda i: F.concat(F.lit("- "), i["name"], F.lit(" ("), F.size(i[inner]), F.lit(f" {unit})\n"))
    )
    return F.array_join(lines, "")


def structure_prompts(comps: DataFrame, context: str = "context") -> DataFrame:
    """Packed texts of a component for structure analysis, with their token estimates.

    One prompt per part of :func:`component_parts`, so each stays far below a model's window and together they show
    the whole component.
    """
    parts = component_parts(comps.withColumn("context", F.col(context)))
    packed = F.concat(
        F.lit("Component: "), "name", F.lit(" ("), "path", F.lit(")\n\nClasses:\n"),
        _counted(F.col("classes"), "methods", "methods"), F.lit("\nFunctions:\n"),
        _counted(F.col("functions"), "parameters", "params"), F.lit("\nImports: "),
        F.array_join("imports", ", "), F.lit("\nCode snippet: "), F.col("context"),
    )
    return parts.select("repo_id", "path", "part", packed.alias("prompt")).withColumn("tokens", X.token_count("prompt"))


def _texts(items: list[str], when: Column | None = None) -> Column:
    full = F.array(*[F.lit(i) for i in items])
    return full if when is None else F.when(when, full).otherwise(F.array().cast("array<string>"))


def component_questions(comps: DataFrame, purpose: str = "purpose", priority: Column | None = None) -> DataFrame:
    """``(repo_id, path, pos, question)``: all questions that apply to a component."""
    ext = P.extension("path")
    aim = F.lower(F.coalesce(F.col(purpose), F.lit("")))
    first = priority if priority is not None else (F.col("is_entry_point") | F.col("is_critical"))
    asked = F.concat(
        _texts(K.BASE_QUESTIONS),
        _texts(K.LANGUAGE_QUESTIONS[".php"], ext == ".php"),
        _texts(K.LANGUAGE_QUESTIONS[".js"], ext.isin(K.SCRIPT_EXTENSIONS)),
        _texts(K.LANGUAGE_QUESTIONS[".py"], ext == ".py"),
        _texts(K.DATABASE_QUESTIONS, F.contains(aim, F.lit("database")) | F.contains(aim, F.lit("db"))),
        _texts(K.LOGIN_QUESTIONS, F.contains(aim, F.lit("auth")) | F.contains(aim, F.lit("login"))),
        _texts(K.PRIORITY_QUESTIONS, first),
    )
    return comps.select(
        "repo_id", "path", "ord", F.posexplode(asked).alias("pos", "question")
    )


def flow_questions(flows: DataFrame) -> DataFrame:
    """The questions asked about every data flow, with their retrieval text."""
    asked = F.array(*[F.lit(q) for q in K.FLOW_QUESTIONS])
    return flows.select("repo_id", "source", "function", F.posexplode(asked).alias("pos", "question")).withColumn(
        "query", F.concat_ws(" ", "source", "function", "question")
    )


def flow_boundary_context(flows: DataFrame, members: DataFrame, boundaries: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Boundaries that contain a crossing flow's source, one line each, then a warning.

    ``marks(repo_id, source)`` are the distinct sources of crossing flows, where they are known.

    Lines are built per distinct source, not per flow; a source is in as many
    boundaries as list it.  The text goes to the sources of crossing flows, by whose key the flows lie since they were
    flagged, so flows are not spread again.
    """
    shared = [c for c in ["repo_id"] if c in members.columns]
    sources = (
        members.join(boundaries, [*shared, "boundary"])
        .select(*shared, F.col("member").alias("source"), "boundary", "description", "ord")
        .distinct()
    )
    line = F.concat(
        F.lit("Source is within security boundary: "), "boundary", F.lit(" - "),
        F.coalesce("description", F.lit("")), F.lit("\n"),
    )
    text = (
        sources.withColumn("line", line)
        .groupBy(*shared, "source")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("lines"))
        .select(*shared, "source", F.array_join(F.transform("lines", lambda s: s["line"]), "").alias("__text"))
    )
    crossing = flows.filter("crosses_boundary").select("repo_id", "source").distinct() if marks is None else marks.select("repo_id", "source")
    return (
        flows.join(crossing.join(text, [*shared, "source"]), ["repo_id", "source"], "left")
        .withColumn(
            "boundary_context",
            F.when(
                F.col("crosses_boundary"), F.concat(F.coalesce("__text", F.lit("")), F.lit(K.BOUNDARY_WARNING))
            ).otherwise(""),
        )
        .drop("__text")
    )


def boundary_context_lines(flows: DataFrame, members: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``(repo_id, source, line_no, line)``: the lines of :func:`flow_boundary_context` as rows, numbered from 1.

    One text per crossing *source*, not per flow, and never put together: a source in any number of boundaries stays
    spread.  The last line is the warning; a source in no boundary has only that.
    """
    shared = [c for c in ["repo_id"] if c in members.columns]
    crossing = flows.filter("crosses_boundary").select("repo_id", "source").distinct()
    described = members.join(boundaries, [*shared, "boundary"]).select(
        *shared, F.col("member").alias("source"), "boundary", F.coalesce("description", F.lit("")).alias("description"), "ord"
    ).distinct()
    inside = crossing.join(described, [*shared, "source"]).select(
        "repo_id", "source", F.lit(0).alias("last"), F.col("ord").cast("long").alias("ord"),
        F.concat(F.lit("Source is within security boundary: "), "boundary", F.lit(" - "), "description").alias("line"),
    )
    warning = crossing.select(
        "repo_id", "source", F.lit(1).alias("last"), F.lit(0).cast("long").alias("ord"), F.lit(K.BOUNDARY_WARNING).alias("line")
    )
    placed = with_position(inside.unionByName(warning), ["repo_id", "source"], "ord", "line_no", tier="last", then=["line"])
    return placed.select("repo_id", "source", "line_no", "line")


def first_crossing_flows(flows: DataFrame, crossing: DataFrame, limit: int = 5) -> DataFrame:
    """Cross-boundary flows among which the first ``limit`` of each repository by (``ord``, source, destination) are.

    Every flow of a crossing source has at least one destination, so the first flows hold the first pairs: pairs of
    flows and destinations are made for ``limit`` flows of a repository only.
    """
    usable = flows.filter((F.col("source") != "") & (F.col("function") != ""))
    crosses = usable.join(crossing.select("repo_id", "source").distinct(), ["repo_id", "source"], "left_semi")
    first = first_per_group(crosses, ["repo_id"], [F.asc("ord"), F.asc("source")], limit).drop("rank")
    return first.join(crossing, ["repo_id", "source"])


def cross_flow_samples(cross: DataFrame, limit: int = 5) -> DataFrame:
    """First cross-boundary flows of each repository as context lines."""
    ranked = first_per_group(cross, ["repo_id"], [F.asc("ord"), F.asc("source"), F.asc("destination")], limit, "position")
    line = F.concat(
        "source", F.lit(" -> "), "destination", F.lit(" (from "), "source_boundary", F.lit(" to "),
        "destination_boundary", F.lit(")"),
    )
    return ranked.select("repo_id", F.col("position").cast("long").alias("position"), line.alias("line"))


def entry_point_samples(comps: DataFrame, limit: int = 5) -> DataFrame:
    """First entry points of each repository on one line."""
    ranked = first_per_group(comps.filter("is_entry_point"), ["repo_id"], [F.asc("ord")], limit)
    return (
        ranked.groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("xs"))
        .select(
            "repo_id",
            F.concat(F.lit("Entry points: "), F.array_join(F.transform("xs", lambda x: x["path"]), ", ")).alias("line"),
        )
    )
