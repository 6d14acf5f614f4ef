"""Registered queries over the corpus: scan filter, rollups, structure, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K, paths as P
from ..functions.nested import items
from ..operators import rollups as R, select as S, structure as T
from ..session import stage
from ..sources import corpus
from .oracle_text import any_contains, in_list, over_files, over_symbols, words
from .views import table, view


def code_files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "code_files")


def scanned(spark: SparkSession, d: str) -> DataFrame:
    return corpus.filter_files(code_files(spark, d))


def comps(spark: SparkSession, d: str) -> DataFrame:
    return T.components(scanned(spark, d))


def flat_comps(spark: SparkSession, d: str) -> DataFrame:
    """Components without their extracted structure, for queries over paths and flags."""
    return T.source_files(scanned(spark, d)).select("repo_id", "path", "name", "type", "is_entry_point", "ord")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Component structure written once, for queries that read it in several branches."""
    return stage(comps(spark, d).drop("content"), "components")


def corpus_filter(spark, d):
    return scanned(spark, d).select(
        "repo_id", P.normalise("path").alias("path"), P.extension("path").alias("ext"),
        P.display_language(P.extension("path")).alias("language"), "length",
    )


def entry_points(spark, d):
    return code_files(spark, d).select("repo_id", "path", P.is_entry_point("path", "content").alias("is_entry_point"))


def extension_histogram(spark, d):
    return R.extension_histogram(code_files(spark, d)).select(
        "repo_id", "ext", "files", F.round("percentage", 6).alias("percentage"), "language"
    )


def top_extensions(spark, d):
    top = R.top_extensions(R.extension_counts(scanned(spark, d)), 3)
    return top.select("repo_id", "ext", "files", F.col("rank").cast("long").alias("rank"))


def key_directories(spark, d):
    return R.key_directories(flat_comps(spark, d)).withColumn("languages", F.array_join("languages", "|"))


def symbols(spark, d):
    return T.symbols(comps(spark, d)).select(
        "repo_id", "path", "kind", "parent", "name", F.array_join("parameters", ",").alias("parameters")
    )


def data_flows(spark, d):
    return T.data_flows(comps(spark, d)).select(
        "repo_id", "path", "source", "function", F.array_join("parameters", ",").alias("parameters")
    )


def dependencies(spark, d):
    return comps(spark, d).select("repo_id", "path", F.posexplode(items("dependencies")).alias("pos", "dep")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def import_edges(spark, d):
    paths = scanned(spark, d).select("repo_id", "path", "ord")
    return T.import_edges(comps(spark, d), paths)


def dependency_edges(spark, d):
    return T.dependency_edges(parsed(spark, d)).select("repo_id", "src_path", "dep_pos", "dep", "dst_path")


def file_relationships(spark, d):
    c = parsed(spark, d)
    return T.relationships(c, T.dependency_edges(c))


def incremental_skip(spark, d):
    files = code_files(spark, d)
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("ord"))
    indexed = files.join(labelled, "ord", "left_semi").select("repo_id", F.translate("path", "/", "\\").alias("path"))
    return S.not_indexed(files, indexed).select("repo_id", "path", "ord")


def critical_flags(spark, d):
    return S.flag_critical(flat_comps(spark, d)).select("repo_id", "path", "is_entry_point", "is_critical")


SEARCHES = ["*auth*", "src/*/*.p?", "model"]


def path_search(spark, d):
    files = stage(scanned(spark, d).select("repo_id", "path", "ord"), "paths")
    parts = [
        S.path_search(files, p).select("repo_id", F.lit(p).alias("pattern"), "path", F.col("rank").cast("long").alias("rank"))
        for p in SEARCHES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def priority_components(spark, d):
    return S.priority_components(flat_comps(spark, d)).select(
        "repo_id", "path", "is_priority", F.col("position").cast("long").alias("position")
    )


def tiered_files(spark, d):
    return S.tiered_files(flat_comps(spark, d)).select("repo_id", "path", "ord", "tier")


def capped_files(spark, d):
    return S.capped_files(S.tiered_files(flat_comps(spark, d))).select("repo_id", "path", "tier", "position")


def restricted_edges(spark, d):
    c = parsed(spark, d)
    files = S.capped_files(S.tiered_files(c))
    return T.related_files(*S.restricted_halves(*T.dependency_tables(c), files)).select("repo_id", "src_path", "dst_path", "dep_pos")


QUERIES = {
    "corpus_filter": corpus_filter,
    "entry_points": entry_points,
    "repo_validity": lambda s, d: R.repo_validity(code_files(s, d)),
    "extension_histogram": extension_histogram,
    "top_extensions": top_extensions,
    "primary_language": lambda s, d: R.primary_language(code_files(s, d)),
    "dominant_language": lambda s, d: R.dominant_language(scanned(s, d)),
    "tech_stack": lambda s, d: R.tech_stack(stage(scanned(s, d).select("repo_id", "path"), "paths")),
    "stack_entries": lambda s, d: R.stack_entries(scanned(s, d)),
    "architecture_pattern": lambda s, d: R.architecture_pattern(scanned(s, d)),
    "extension_boundaries": lambda s, d: R.extension_boundaries(flat_comps(s, d)),
    "key_directories": key_directories,
    "unique_files": lambda s, d: R.unique_files(code_files(s, d)),
    "symbols": symbols,
    "data_flows": data_flows,
    "flows_by_source": lambda s, d: T.flows_by_source(T.data_flows(comps(s, d))),
    "dependencies": dependencies,
    "import_edges": import_edges,
    "dependency_edges": dependency_edges,
    "file_relationships": file_relationships,
    "incremental_skip": incremental_skip,
    "critical_files": lambda s, d: S.critical_files(flat_comps(s, d)),
    "critical_flags": critical_flags,
    "path_search": path_search,
    "priority_components": priority_components,
    "tiered_files": tiered_files,
    "capped_files": capped_files,
    "restricted_edges": restricted_edges,
}

_LANG_SCAN = (
    "langfiles AS (SELECT * FROM files WHERE NOT starts_with(base, '.') AND NOT "
    + any_contains("dir", K.LANGUAGE_SCAN_SKIP) + ")"
)
_EXT = "SELECT repo_id, ext, count(*) AS n FROM corpus WHERE ext <> '' GROUP BY ALL"

_DEP_EDGES = """dedges AS (
  SELECT d.repo_id, d.path AS src_path, d.dpos AS dep_pos, d.dep, c.path AS dst_path
  FROM deps d JOIN comps c ON c.repo_id = d.repo_id AND contains(c.path, d.dep) AND c.path <> d.path)"""


def _hits(name: str, items: list[str], lower: bool = False) -> str:
    """Matching paths per word and repository."""
    p = "lower(path)" if lower else "path"
    return (
        words(name + "_words", items)
        + f""", {name} AS (SELECT repo_id, path, ord, pos FROM comps, {name}_words WHERE contains({p}, word))"""
    )


CRITICAL_CTES = ", ".join(
    [
        _hits("sec", K.SECURITY_WORDS), _hits("dbs", K.DATABASE_WORDS),
        """critical AS (SELECT repo_id, path FROM comps WHERE is_entry UNION SELECT repo_id, path FROM sec
        UNION SELECT repo_id, path FROM dbs)""",
    ]
)
_TIERS = [w for g in K.TIER_WORDS.values() for w in g]
_TIERED = (
    _hits("tier", _TIERS)
    + f""", tiered AS (SELECT c.repo_id, c.path, c.ord, c.is_entry, CASE WHEN c.is_entry THEN 0 ELSE
      coalesce((SELECT min(pos) + 1 FROM tier t WHERE t.repo_id = c.repo_id AND t.path = c.path), {len(_TIERS) + 1}) END AS tier
      FROM comps c)"""
)
_CAPPED = """capped AS (SELECT repo_id, path, tier, row_number() OVER (PARTITION BY repo_id ORDER BY tier, ord) AS position FROM tiered)"""

CHOSEN = f"""SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY is_priority DESC, ord) AS position FROM (
  SELECT *, is_entry OR {any_contains('lower(path)', K.PRIORITY_WORDS)} AS is_priority FROM comps)"""

ORACLE = {
    "corpus_filter": over_files(
        "SELECT repo_id, path, c.ext, coalesce(d.language, 'Unknown') AS language, length FROM corpus c LEFT JOIN display d ON d.ext = c.ext"
    ),
    "entry_points": over_files("SELECT repo_id, path, is_entry AS is_entry_point FROM files"),
    "repo_validity": over_files(
        f"""SELECT repo_id, count(*) FILTER (WHERE NOT starts_with(path, '.git/')) AS files,
        bool_or(NOT starts_with(path, '.git/')) AS is_valid,
        bool_or(split_part(path, '/', 1) IN {in_list(K.REPO_INDICATORS)}) AS has_indicator FROM files GROUP BY 1"""
    ),
    "extension_histogram": over_files(
        """SELECT h.repo_id, h.ext, n AS files, round(n * 100.0 / total, 6) AS percentage, coalesce(g.language, 'unknown') AS language
        FROM (SELECT repo_id, ext, count(*) AS n FROM langfiles WHERE ext <> '' GROUP BY ALL) h
        JOIN (SELECT repo_id, CAST(count(*) AS DOUBLE) AS total FROM langfiles GROUP BY 1) t USING (repo_id)
        LEFT JOIN grammar g ON g.ext = h.ext""",
        _LANG_SCAN,
    ),
    "top_extensions": over_files(
        f"""SELECT repo_id, ext, n AS files, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, ext) AS rank
        FROM ({_EXT})) WHERE rank <= 3"""
    ),
    "primary_language": over_files(
        """SELECT r.repo_id, coalesce(language, 'python') AS primary_language FROM (SELECT DISTINCT repo_id FROM files) r
        LEFT JOIN (SELECT repo_id, language, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, ext) AS rn FROM (
          SELECT repo_id, l.ext, g.language, count(*) AS n FROM langfiles l JOIN grammar g ON g.ext = l.ext GROUP BY ALL)) b
        ON b.repo_id = r.repo_id AND rn = 1""",
        _LANG_SCAN,
    ),
    "dominant_language": over_files(
        f"""SELECT r.repo_id, CASE WHEN b.ext IS NOT NULL THEN coalesce(d.language, 'Unknown') END AS dominant_language
        FROM (SELECT DISTINCT repo_id FROM corpus) r LEFT JOIN (
          SELECT repo_id, ext, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, ext) AS rn FROM ({_EXT})) b
        ON b.repo_id = r.repo_id AND rn = 1 LEFT JOIN display d ON d.ext = b.ext"""
    ),
    "tech_stack": over_files(
        f"""SELECT r.repo_id, coalesce(string_agg(item, ', ' ORDER BY rn) FILTER (WHERE rn <= 3), 'Unknown technology stack') AS tech_stack
        FROM (SELECT DISTINCT repo_id FROM corpus) r LEFT JOIN (
          SELECT repo_id, ext || ' (' || n || ' files)' AS item, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, ext) AS rn
          FROM ({_EXT})) e ON e.repo_id = r.repo_id GROUP BY 1"""
    ),
    "stack_entries": over_files(f"SELECT repo_id, ext, n AS files, ext || ' (' || n || ' files)' AS entry FROM ({_EXT})"),
    "architecture_pattern": over_files(
        """SELECT repo_id, CASE WHEN list_contains(list(ext), '.php') THEN 'PHP Web Application'
        WHEN list_contains(list(ext), '.py') THEN 'Python Application'
        WHEN len(list_intersect(list(ext), ['.js', '.jsx', '.ts'])) > 0 THEN 'JavaScript/TypeScript Application'
        ELSE 'Unknown' END AS architecture_pattern FROM corpus GROUP BY 1"""
    ),
    "extension_boundaries": over_files(
        """SELECT repo_id, upper(e[2:]) || ' Components' AS boundary, 'Automatically detected boundary for ' || e || ' files' AS description,
        position, path FROM (SELECT repo_id, e, path, row_number() OVER (PARTITION BY repo_id, e ORDER BY ord) AS position
        FROM comps JOIN (VALUES ('.php'), ('.py'), ('.js')) v(e) ON ends_with(path, e))"""
    ),
    "key_directories": over_files(
        f"""SELECT repo_id, dir AS directory, count(*) AS file_count, string_agg(DISTINCT type, '|' ORDER BY type) AS languages,
        bool_or(is_entry) AS contains_entry_point FROM comps GROUP BY repo_id, dir
        HAVING count(*) > 1 AND (bool_or(is_entry) OR {any_contains('lower(dir)', K.KEY_DIRECTORY_WORDS)})"""
    ),
    "unique_files": over_files("SELECT DISTINCT repo_id, replace(path, '\\', '/') AS path FROM files"),
    "symbols": over_symbols("SELECT repo_id, path, kind, parent, name, parameters FROM syms"),
    "data_flows": over_symbols("SELECT repo_id, path, source, function, parameters FROM dflows"),
    "flows_by_source": over_symbols(
        "SELECT repo_id, source, count(*) AS flow_count, count(DISTINCT function) AS function_count FROM dflows GROUP BY 1, 2"
    ),
    "dependencies": over_symbols("SELECT repo_id, path, dpos AS pos, dep FROM deps"),
    "import_edges": over_symbols(
        r"""SELECT repo_id, src_path, import_pos, dst_path FROM (
          SELECT i.repo_id, i.path AS src_path, i.ipos AS import_pos, c.path AS dst_path,
            row_number() OVER (PARTITION BY i.path, i.ipos, c.dir ORDER BY c.ord) AS rn
          FROM imports i JOIN corpus c ON c.repo_id = i.repo_id
            AND c.base IN (regexp_extract(i.imp, '[^/\\]*$'), regexp_extract(i.imp, '[^/\\]*$') || '.py', regexp_extract(i.imp, '[^/\\]*$') || '.js')
          WHERE regexp_matches(i.imp, '[/\\]')) WHERE rn = 1"""
    ),
    "dependency_edges": over_symbols("SELECT repo_id, src_path, dep_pos, dep, dst_path FROM dedges", _DEP_EDGES),
    "file_relationships": over_symbols(
        """SELECT c.repo_id, c.path AS src_path, e.dst_path FROM comps c LEFT JOIN dedges e
        ON e.repo_id = c.repo_id AND e.src_path = c.path""",
        _DEP_EDGES,
    ),
    "incremental_skip": over_files(
        "SELECT repo_id, path, ord FROM files WHERE ord NOT IN (SELECT doc_id FROM labels)"
    ),
    "critical_files": over_files("SELECT repo_id, path FROM critical", CRITICAL_CTES),
    "critical_flags": over_files(
        """SELECT repo_id, path, is_entry AS is_entry_point, (repo_id, path) IN (SELECT (repo_id, path) FROM critical) AS is_critical
        FROM comps""",
        CRITICAL_CTES,
    ),
    "path_search": over_files(
        """SELECT repo_id, pattern, path, rank FROM (SELECT repo_id, pattern, path,
        row_number() OVER (PARTITION BY repo_id, pattern ORDER BY ord) AS rank
        FROM corpus JOIN (VALUES ('*auth*'), ('src/*/*.p?'), ('model')) v(pattern)
        ON CASE WHEN pattern = 'model' THEN contains(path, pattern)
          WHEN pattern = '*auth*' THEN path LIKE '%auth%' ELSE path LIKE 'src/%/%.p_' END)"""
    ),
    "priority_components": over_files(f"SELECT repo_id, path, is_priority, position FROM ({CHOSEN})"),
    "tiered_files": over_files("SELECT repo_id, path, ord, tier FROM tiered", _TIERED),
    "capped_files": over_files("SELECT repo_id, path, tier, position FROM capped", _TIERED, _CAPPED),
    "restricted_edges": over_symbols(
        """SELECT repo_id, src_path, dst_path, dep_pos FROM dedges WHERE (repo_id, src_path) IN (SELECT (repo_id, path) FROM capped)
        AND (repo_id, dst_path) IN (SELECT (repo_id, path) FROM capped)""",
        _DEP_EDGES, _TIERED, _CAPPED,
    ),
}
