"""Code structure: classes, functions, imports, data flows and file relations.

A file is cut into top-level statements: a line that starts in column 0 with
anything but whitespace or a closing/opening bracket opens a statement, the
lines up to the next such line belong to it.  All of it happens inside the row
with array functions, so structure extraction is a narrow map over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P
from ..functions.nested import items
from ..session import stage

FAMILIES = ("python", "php", "javascript")

_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_STATEMENT = r"^[^ \t\r{})]"
_CLASS = rf"^(?:abstract[ \t]+|final[ \t]+)*class[ \t]+{_NAME}"
_SCRIPT_FUNCTION = rf"^(?:async[ \t]+)?function[ \t]*[*&]?[ \t]*{_NAME}[ \t]*\(([^)]*)"
_FUNCTION = {
    "python": rf"^(?:async[ \t]+)?def[ \t]+{_NAME}[ \t]*\(([^)]*)",
    "php": _SCRIPT_FUNCTION,
    "javascript": _SCRIPT_FUNCTION,
}
_MODIFIERS = "public|private|protected|static|final|abstract"
_METHOD = {
    "python": rf"(?m)^([ \t]+)(?:async[ \t]+)?def[ \t]+{_NAME}[ \t]*\(([^)]*)\)",
    "php": rf"(?m)^([ \t]+)(?:(?:{_MODIFIERS})[ \t]+)*function[ \t]*&?[ \t]*{_NAME}[ \t]*\(([^)]*)\)",
    "javascript": rf"(?m)^([ \t]+)(?:(?:static|async|get|set)[ \t]+|[*])*{_NAME}[ \t]*\(([^)]*)\)[ \t]*\{{",
}
_PY_IMPORT = r"^(?:import[ \t]+[A-Za-z_.]|from[ \t]+[^ \t]+[ \t]+import[ \t(*])"
_JS_IMPORT = r"^import[ \t{*]"
_JS_LEXICAL = r"^(?:const|let)[ \t]"
_PHP_INCLUDE = r"^(?:include|require)(?:_once)?[ \t]*\(?[ \t]*([^;)]*)"
_QUOTED = r"[\x22\x27]([^\x22\x27]+)[\x22\x27]"
_WS = r"' \t\n\r\u000b\u000c'"

# The expressions below are SQL text over one file's columns; ``rx`` quotes a
# pattern as a raw literal.


def rx(pattern: str) -> str:
    return f"r'{pattern}'"


def _parameters(text: str, family: str) -> str:
    """Parameter names: bare identifiers only (PHP: the ``$name`` of each parameter)."""
    if family == "php":
        names = f"transform(split({text}, ','), p -> regexp_extract(p, {rx(r'([$][A-Za-z0-9_]+)')}, 1))"
        return f"filter({names}, p -> p <> '')"
    trimmed = f"transform(split({text}, ','), p -> btrim(p, {_WS}))"
    return f"filter({trimmed}, p -> p rlike {rx('^' + _NAME + '$')})"


def _methods(statement: str, family: str) -> str:
    """Methods at the first indentation level of a class statement."""
    m = rx(_METHOD[family])
    found = (
        f"arrays_zip(regexp_extract_all({statement}, {m}, 1), regexp_extract_all({statement}, {m}, 2), "
        f"regexp_extract_all({statement}, {m}, 3))"
    )
    # Zipped fields are numbered: `0` indentation, `1` name, `2` parameter text.
    least = "array_min(transform(fs, g -> length(g.`0`)))"
    method = f"named_struct('name', f.`1`, 'parameters', {_parameters('f.`2`', family)})"
    built = f"transform(filter(fs, f -> length(f.`0`) = indent), f -> {method})"
    return f"flatten(transform(array({found}), fs -> flatten(transform(array({least}), indent -> {built}))))"


def _classes(family: str) -> str:
    return (
        f"transform(filter(statements, s -> s rlike {rx(_CLASS)}), "
        f"s -> named_struct('name', regexp_extract(s, {rx(_CLASS)}, 1), 'methods', {_methods('s', family)}))"
    )


def _functions(family: str) -> str:
    f = rx(_FUNCTION[family])
    return (
        f"transform(filter(statements, s -> s rlike {f}), s -> named_struct('name', regexp_extract(s, {f}, 1), "
        f"'parameters', {_parameters(f'regexp_extract(s, {f}, 2)', family)}))"
    )


_IS_LEXICAL = f"s rlike {rx(_JS_LEXICAL)} AND (contains(s, 'require(') OR contains(s, 'import '))"


def _imports(family: str) -> str:
    if family == "python":
        return f"transform(filter(statements, s -> s rlike {rx(_PY_IMPORT)}), s -> btrim(s, {_WS}))"
    if family == "javascript":
        return f"transform(filter(statements, s -> s rlike {rx(_JS_IMPORT)} OR ({_IS_LEXICAL})), s -> btrim(s, {_WS}))"
    include = rx(_PHP_INCLUDE)
    return (
        f"transform(filter(statements, s -> s rlike {include}), "
        f"s -> concat('include ', btrim(regexp_extract(s, {include}, 1), {_WS})))"
    )


def _dependencies(family: str) -> str:
    """Root module of an import, quoted strings of a require, unquoted include path."""
    module = f"array(regexp_extract(s, {rx('^(?:import|from) ([^ .]*)')}, 1))"
    quoted = f"regexp_extract_all(s, {rx(_QUOTED)}, 1)"
    found = {
        "python": module,
        "javascript": f"IF({_IS_LEXICAL}, {quoted}, {module})",
        "php": "array(btrim(substring(s, 9), '\"\\''))",
    }[family]
    # An empty name refers to nothing; it would match every path.
    return f"filter(flatten(transform(imports, s -> {found})), d -> d <> '')"


_FN = "array<struct<name string, parameters array<string>>>"
_EMPTY = {
    "classes": f"array<struct<name string, methods {_FN}>>", "functions": _FN,
    "imports": "array<string>", "dependencies": "array<string>",
}


# Lines and statement starts are bound as lambda variables: each is computed once
# per file and the content occurs once in the plan.
_STATEMENTS = f"""CASE WHEN family IN ({", ".join(f"'{f}'" for f in FAMILIES)}) THEN
  flatten(transform(array(split(content, '\\n', -1)), lines -> flatten(transform(
    array(filter(transform(lines, (l, i) -> IF(l rlike {rx(_STATEMENT)}, i + 1, NULL)), i -> i IS NOT NULL)),
    starts -> transform(starts, (s, j) ->
      array_join(slice(lines, s, coalesce(get(starts, j + 1), size(lines) + 1) - s), '\\n')))))) END AS statements"""


def _by_family(build, name: str) -> Column:
    cases = " ".join(f"WHEN '{f}' THEN {build(f)}" for f in FAMILIES)
    return F.expr(f"CASE family {cases} ELSE from_json('[]', '{_EMPTY[name]}') END AS {name}")


def source_files(files: DataFrame, primary_only: DataFrame | None = None) -> DataFrame:
    """Files that become components, with their path-level columns.

    ``primary_only`` takes the output of ``rollups.primary_language`` to keep the
    files of each repository's primary language only.
    """
    base = files.filter(P.is_component("path")).select(
        "repo_id", "path", P.basename("path").alias("name"),
        P.display_language(P.raw_extension("path")).alias("type"),
        P.is_entry_point("path", "content").alias("is_entry_point"), F.lit(False).alias("is_critical"),
        "ord", "content", P.grammar_language(P.extension("path")).alias("family"),
    )
    if primary_only is not None:
        wanted = primary_only.withColumnRenamed("primary_language", "family")
        base = base.join(wanted, ["repo_id", "family"], "left_semi")
    return base


def components(files: DataFrame, primary_only: DataFrame | None = None) -> DataFrame:
    """One row per source file with its extracted structure."""
    cut = source_files(files, primary_only).select("*", F.expr(_STATEMENTS))
    parsed = cut.select(
        "*", _by_family(_classes, "classes"), _by_family(_functions, "functions"), _by_family(_imports, "imports")
    )
    return parsed.select(
        "repo_id", "path", "name", "type", "classes", "functions", "imports",
        _by_family(_dependencies, "dependencies"), "is_entry_point", "is_critical", "ord", "content",
    )


def symbols(comps: DataFrame) -> DataFrame:
    """Flat ``(repo_id, path, kind, parent, name, parameters)`` rows from one explode."""
    none = F.array().cast("array<string>")
    row = lambda kind, parent, name, params: F.struct(
        F.lit(kind).alias("kind"), parent.alias("parent"), name.alias("name"), params.alias("parameters")
    )
    empty = F.lit("")
    all_symbols = F.concat(
        F.transform("classes", lambda c: row("class", empty, c["name"], none)),
        F.flatten(
            F.transform(
                "classes",
                lambda c: F.transform(c["methods"], lambda m: row("method", c["name"], m["name"], m["parameters"])),
            )
        ),
        F.transform("functions", lambda f: row("function", empty, f["name"], f["parameters"])),
        F.transform("imports", lambda i: row("import", empty, i, none)),
        F.transform("dependencies", lambda d: row("dependency", empty, d, none)),
    )
    return comps.select("repo_id", "path", "ord", F.posexplode(all_symbols).alias("seq", "s")).select(
        "repo_id", "path", "ord", "seq", "s.*"
    )


def data_flows(comps: DataFrame) -> DataFrame:
    """A flow per function (source: file) and per method (source: file.Class)."""
    row = lambda source, f: F.struct(
        source.alias("source"), f["name"].alias("function"), f["parameters"].alias("parameters")
    )
    flows = F.concat(
        F.transform("functions", lambda f: row(F.col("name"), f)),
        F.flatten(
            F.transform(
                "classes",
                lambda c: F.transform(c["methods"], lambda m: row(F.concat(F.col("name"), F.lit("."), c["name"]), m)),
            )
        ),
    )
    return comps.select("repo_id", "path", "ord", F.posexplode(flows).alias("seq", "f")).select(
        "repo_id", "path", "ord", "seq", "f.*"
    )


def flows_by_source(flows: DataFrame) -> DataFrame:
    """Flows and distinct functions per source; the flows themselves stay rows."""
    return flows.groupBy("repo_id", "source").agg(
        F.count(F.lit(1)).alias("flow_count"), F.countDistinct("function").alias("function_count")
    )


def import_edges(comps: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve path-like imports to files by base name, one file per directory.

    Hash join on (repository, base name); the candidate names of an import are
    exploded instead of scanning every file per import.
    """
    last = F.substring_index(P.normalise("import"), "/", -1)
    wanted = (
        comps.select("repo_id", F.col("path").alias("src_path"), F.posexplode(items("imports")).alias("import_pos", "import"))
        .filter(F.col("import").rlike(r"[/\\]"))
        .withColumn("base", F.explode(F.array(last, F.concat(last, F.lit(".py")), F.concat(last, F.lit(".js")))))
    )
    targets = files.select(
        "repo_id", P.basename("path").alias("base"), P.dirname("path").alias("dir"), F.col("path").alias("dst_path"),
        F.col("ord").alias("dst_ord"),
    )
    return (
        wanted.join(targets, ["repo_id", "base"])
        .groupBy("repo_id", "src_path", "import_pos", "dir")
        .agg(F.min(F.struct("dst_ord", "dst_path"))["dst_path"].alias("dst_path"))
        .select("repo_id", "src_path", F.col("import_pos").cast("long").alias("import_pos"), "dst_path")
    )


def _grams(text: Column, n: Column) -> Column:
    """Distinct substrings of length n (none when the text is shorter)."""
    last = F.length(text) - n + 1
    return F.when(
        last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: text.substr(i, n)))
    ).otherwise(F.array().cast("array<string>"))


def dependency_tables(comps: DataFrame, gram: int = 4) -> tuple[DataFrame, DataFrame]:
    """The two halves of the dependency relation: ``(repo_id, src_path, dep_pos, dep)``, one row per dependency of a file,
    and ``(repo_id, dep, dst_path)``, the files whose path contains the dependency or whose ``module_name``, if there is
    such a column, equals it.  Both grow with their input; only their join has a row for every pair of files.

    Substring matching without a nested loop.  Each *distinct* dependency is
    looked up by its single rarest gram of ``gram`` characters (one shorter than
    that by itself), and the few candidates are verified.  A repository's paths
    are only cut into the gram lengths its dependencies have, and only grams
    that some dependency asks for are kept.
    """
    paths = comps.select("repo_id", F.col("path").alias("dst_path"))
    deps = comps.select(
        "repo_id", F.col("path").alias("src_path"), F.posexplode(items("dependencies")).alias("dep_pos", "dep")
    ).filter(F.col("dep") != "")
    wanted = deps.select("repo_id", "dep").distinct().withColumn("n", F.least(F.length("dep"), F.lit(gram)))
    probes = wanted.select("repo_id", "dep", F.explode(_grams(F.col("dep"), F.col("n"))).alias("gram"))
    index = (
        paths.join(wanted.select("repo_id", "n").distinct(), "repo_id")
        .select("repo_id", "dst_path", F.explode(_grams(F.col("dst_path"), F.col("n"))).alias("gram"))
        .join(probes.select("repo_id", "gram").distinct(), ["repo_id", "gram"], "left_semi")
    )
    index = stage(index, "gram-index")  # counted and probed
    frequency = index.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no path has rules its dependency out.
    rarest = (
        probes.join(frequency, ["repo_id", "gram"], "left")
        .groupBy("repo_id", "dep")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        .filter(F.col("best.n") > 0)
        .select("repo_id", "dep", F.col("best.gram").alias("gram"))
    )
    hits = (
        rarest.join(index, ["repo_id", "gram"])
        .filter(F.contains("dst_path", F.col("dep")))
        .select("repo_id", "dep", "dst_path")
    )
    if "module_name" in comps.columns:
        named = comps.select("repo_id", F.col("module_name").alias("dep"), F.col("path").alias("dst_path")).filter(F.col("dep") != "")
        asked = named.join(wanted.select("repo_id", "dep"), ["repo_id", "dep"], "left_semi")
        hits = hits.unionByName(asked.filter(~F.contains("dst_path", F.col("dep"))))
    return deps.withColumn("dep_pos", F.col("dep_pos").cast("long")), hits


def related_files(deps: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs of files: the halves of the dependency relation joined, files related to themselves left out."""
    return (
        deps.join(hits, ["repo_id", "dep"])
        .filter(F.col("src_path") != F.col("dst_path"))
        .select("repo_id", "src_path", "dep_pos", "dep", "dst_path")
    )


def dependency_edges(comps: DataFrame, gram: int = 4) -> DataFrame:
    """For every dependency of a file, the other files that it names."""
    return related_files(*dependency_tables(comps, gram))


def relationships(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file with its related files; files without any keep one row."""
    return (
        comps.select("repo_id", F.col("path").alias("src_path"))
        .join(edges.select("repo_id", "src_path", "dst_path"), ["repo_id", "src_path"], "left")
    )
