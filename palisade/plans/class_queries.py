"""Inheritance of classes over derived files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import inheritance as I, structure as T
from ..session import stage
from .views import ctes, view


def _edges(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "class_files")
    imports = T.import_edges(T.components(files), files)
    return stage(I.inheritance_edges(stage(I.class_statements(files), "classes"), imports), "inheritance")


def inheritance_edges(spark, d):
    place = {c: F.col(c).cast("long") for c in ("seq", "pos")}
    return _edges(spark, d).withColumns(place | {"parent_path": F.coalesce("parent_path", F.lit("")), "parent_seq": F.coalesce("parent_seq", F.lit(-1)).cast("long")})


def class_ancestors(spark, d):
    return I.ancestors(_edges(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("seq", "ancestor_seq", "depth")})


def inheritance_lines(spark, d):
    return I.inheritance_lines(_edges(spark, d)).withColumns({"seq": F.col("seq").cast("long"), "pos": F.col("pos").cast("long")})


QUERIES = {"inheritance_edges": inheritance_edges, "class_ancestors": class_ancestors, "inheritance_lines": inheritance_lines}

_CLASS = r"(?m)^(?:export[ \t]+|default[ \t]+|abstract[ \t]+|final[ \t]+)*class[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)([^\n:{]*)"
_RESOLVED = rf"""{ctes("class_files")},
  heads AS (
    SELECT repo_id, path, ord, generate_subscripts(names, 1) - 1 AS seq, unnest(names) AS class_name, unnest(heads) AS head FROM (
      SELECT *, regexp_extract_all(content, '{_CLASS}', 1) AS names, regexp_extract_all(content, '{_CLASS}', 2) AS heads FROM class_files)),
  listed AS (
    SELECT repo_id, path, ord, seq, class_name, CASE WHEN path LIKE '%.py' THEN string_split(regexp_extract(head, '^[ \t]*\(([^()]*)\)', 1), ',')
      ELSE list_prepend(regexp_extract(head, '[ \t]extends[ \t]+([^ \t\r]+)', 1), string_split(regexp_extract(head, '[ \t]implements[ \t]+(.*)$', 1), ',')) END AS named FROM heads),
  plain AS (
    SELECT * EXCLUDE (named), list_filter(list_transform(list_filter(named, lambda b: NOT contains(b, '=')),
      lambda b: regexp_extract(trim(regexp_replace(b, '\[.*$', '')), '([A-Za-z_$][A-Za-z0-9_$]*)$', 1)), lambda b: b <> '') AS names FROM listed),
  bases AS (SELECT repo_id, path, ord, seq, class_name, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS base FROM plain),
  wanted AS (
    SELECT repo_id, path, string_split(line, '/')[-1] AS last FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line FROM class_files)
    WHERE regexp_matches(line, '^import[ \t]+[A-Za-z_.]') AND contains(line, '/') AND (path NOT LIKE '%.php')),
  imports AS (
    SELECT w.repo_id, w.path, arg_min(f.path, (f.ord, f.path)) AS dst FROM wanted w
      JOIN class_files f ON f.repo_id = w.repo_id AND string_split(f.path, '/')[-1] IN (rtrim(w.last, ' '), w.last || '.py', w.last || '.js')
    GROUP BY w.repo_id, w.path, w.last, regexp_replace(f.path, '/[^/]*$', '')),
  candidates AS (
    SELECT b.repo_id, b.path, b.seq, b.pos, p.path AS parent_path, p.seq AS parent_seq, p.ord AS parent_ord,
      CASE WHEN p.path = b.path THEN 0 WHEN EXISTS (SELECT 1 FROM imports i WHERE i.repo_id = b.repo_id AND i.path = b.path AND i.dst = p.path) THEN 1 ELSE 2 END AS scope
    FROM bases b JOIN plain p ON p.repo_id = b.repo_id AND p.class_name = b.base AND (p.path <> b.path OR p.seq <> b.seq)),
  best AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY repo_id, path, seq, pos ORDER BY scope, parent_ord, parent_path, parent_seq) = 1),
  edges AS (
    SELECT b.repo_id, b.path, b.seq, b.class_name, b.pos, b.base, ['file', 'import', 'repository', 'external'][coalesce(scope, 3) + 1] AS scope, parent_path, parent_seq
    FROM bases b LEFT JOIN best USING (repo_id, path, seq, pos))"""

ORACLE = {
    "inheritance_edges": f"{_RESOLVED} SELECT * REPLACE (coalesce(parent_path, '') AS parent_path, coalesce(parent_seq, -1) AS parent_seq) FROM edges",
    "class_ancestors": f"""{_RESOLVED},
  ways AS (
    SELECT DISTINCT repo_id, path, seq, parent_path AS ancestor_path, parent_seq AS ancestor_seq, 1 AS depth FROM edges WHERE parent_path IS NOT NULL
    UNION
    SELECT w.repo_id, w.path, w.seq, e.parent_path, e.parent_seq, w.depth + 1 FROM ways w
      JOIN edges e ON e.repo_id = w.repo_id AND e.path = w.ancestor_path AND e.seq = w.ancestor_seq WHERE e.parent_path IS NOT NULL AND w.depth < 64)
  SELECT repo_id, path, seq, ancestor_path, ancestor_seq, CAST(min(depth) AS BIGINT) AS depth FROM ways
  WHERE path <> ancestor_path OR seq <> ancestor_seq GROUP BY ALL""",
    "inheritance_lines": f"{_RESOLVED} SELECT repo_id, path, seq, pos, '    ' || base || ' <|-- ' || class_name || ' : inherits' AS line FROM edges",
}
