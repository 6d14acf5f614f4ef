"""SQL building blocks shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions import constants as K
from .views import ctes


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(name: str, cols: str, rows) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def words(name: str, items: list[str]) -> str:
    return values(name, "pos, word", list(enumerate(items)))


def in_list(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


def any_contains(expr: str, items) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(i)})" for i in items) + ")"


def ext_of(path: str) -> str:
    return rf"regexp_extract({path}, '[^/.][^/]*(\.[^./]+)$', 1)"


_MARKS = " OR ".join(
    "(raw_ext = "
    + quote(ext)
    + " AND "
    + any_contains("content", marks)
    + ")"
    for ext, marks in K.ENTRY_MARKS.items()
)

# files: the code_files view with its path parts and flags
FILES = (
    values("grammar", "ext, language", K.GRAMMAR_LANGUAGE.items())
    + ", "
    + values("display", "ext, language", K.DISPLAY_LANGUAGE.items())
    + ", "
    + words("ignores", K.IGNORE_NAMES)
    + rf""", parts AS (
  SELECT *, {ext_of('path')} AS raw_ext, regexp_extract(path, '[^/]*$') AS base,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM code_files
), files AS (
  SELECT *, lower(raw_ext) AS ext, left(base, length(base) - length(raw_ext)) AS stem,
    lower(left(base, length(base) - length(raw_ext))) IN {in_list(K.ENTRY_STEMS)} OR {_MARKS}
    OR (raw_ext = '.php' AND contains(left(content, 100), '<?php')) AS is_entry
  FROM parts
), ignored AS (
  SELECT DISTINCT path FROM (SELECT path, unnest(string_split(path, '/')) AS piece FROM files) p
  JOIN ignores ON piece GLOB word
), corpus AS (
  SELECT f.* FROM files f WHERE NOT contains(lower(path), 'test')
    AND path NOT IN (SELECT path FROM ignored)
), comps AS (
  SELECT c.*, coalesce(d.language, 'Unknown') AS type FROM corpus c LEFT JOIN display d ON d.ext = c.ext
  WHERE c.ext IN {in_list(K.COMPONENT_EXTENSIONS)}
)"""
)

_NAME = "[A-Za-z_$][A-Za-z0-9_$]*"

# syms: one row per symbol, from numbered lines
SYMBOLS = rf"""lines AS (
  SELECT repo_id, path, ord, base, ext, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) AS n FROM comps WHERE ext IN ('.py', '.js', '.php')
), numbered AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^[^ \t\r{{}})]') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS seg
  FROM lines
), segs AS (
  SELECT repo_id, path, ord, base, ext, seg, string_agg(line, chr(10) ORDER BY n) AS txt
  FROM numbered WHERE seg > 0 GROUP BY ALL
), class_segs AS (
  SELECT *, regexp_extract(txt, '^(?:abstract[ \t]+|final[ \t]+)*class[ \t]+({_NAME})', 1) AS cname FROM segs
  WHERE regexp_matches(txt, '^(?:abstract[ \t]+|final[ \t]+)*class[ \t]+{_NAME}')
), method_lines AS (
  SELECT c.repo_id, c.path, c.ord, c.base, c.ext, c.cname, c.seg, n, line,
    CASE c.ext
      WHEN '.py' THEN regexp_extract(line, '^[ \t]+(?:async[ \t]+)?def[ \t]+({_NAME})[ \t]*\([^)]*\)', 1)
      WHEN '.php' THEN regexp_extract(line, '^[ \t]+(?:(?:public|private|protected|static|final|abstract)[ \t]+)*function[ \t]*&?[ \t]*({_NAME})[ \t]*\([^)]*\)', 1)
      ELSE regexp_extract(line, '^[ \t]+(?:(?:static|async|get|set)[ \t]+|[*])*({_NAME})[ \t]*\([^)]*\)[ \t]*\{{', 1)
    END AS mname, regexp_extract(line, '\(([^)]*)\)', 1) AS args, length(regexp_extract(line, '^[ \t]+')) AS indent
  FROM class_segs c JOIN numbered USING (path, seg)
), methods AS (
  SELECT * FROM (SELECT *, min(indent) OVER (PARTITION BY path, seg) AS first_indent FROM method_lines WHERE mname <> '')
  WHERE indent = first_indent
), function_segs AS (
  SELECT *, regexp_extract(txt, '^(?:async[ \t]+)?(?:def[ \t]+|function[ \t]*[*&]?[ \t]*)({_NAME})', 1) AS fname,
    regexp_extract(txt, '\(([^)]*)', 1) AS args FROM segs
  WHERE CASE ext WHEN '.py' THEN regexp_matches(txt, '^(?:async[ \t]+)?def[ \t]+{_NAME}[ \t]*\(')
    ELSE regexp_matches(txt, '^(?:async[ \t]+)?function[ \t]*[*&]?[ \t]*{_NAME}[ \t]*\(') END
), imports AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY seg) - 1 AS ipos FROM (
    SELECT repo_id, path, ord, base, ext, seg, CASE ext
      WHEN '.py' THEN CASE WHEN regexp_matches(txt, '^(?:import[ \t]+[A-Za-z_.]|from[ \t]+[^ \t]+[ \t]+import[ \t(*])') THEN trim(txt, ' ' || chr(9) || chr(10) || chr(13)) END
      WHEN '.js' THEN CASE WHEN regexp_matches(txt, '^import[ \t{{*]') OR (regexp_matches(txt, '^(?:const|let)[ \t]') AND (contains(txt, 'require(') OR contains(txt, 'import '))) THEN trim(txt, ' ' || chr(9) || chr(10) || chr(13)) END
      ELSE CASE WHEN regexp_matches(txt, '^(?:include|require)(?:_once)?[ \t(]') THEN 'include ' || trim(regexp_extract(txt, '^(?:include|require)(?:_once)?[ \t]*\(?[ \t]*([^;)]*)', 1)) END
      END AS imp FROM segs) WHERE imp IS NOT NULL
), deps AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY seg, nth) - 1 AS dpos FROM (
    SELECT repo_id, path, ord, base, seg, unnest(found) AS dep, generate_subscripts(found, 1) AS nth FROM (
      SELECT *, CASE
        WHEN ext = '.js' AND NOT starts_with(imp, 'import') THEN regexp_extract_all(imp, '[''"]([^''"]+)[''"]', 1)
        WHEN ext = '.php' THEN [trim(imp[9:], '''"')]
        ELSE [split_part(split_part(imp, ' ', 2), '.', 1)] END AS found FROM imports)) WHERE dep <> ''
), params AS (
  SELECT kind, repo_id, path, ord, base, ext, parent, name, seg, n, array_to_string(list_filter(
    list_transform(string_split(args, ','), lambda p: CASE WHEN ext = '.php' THEN regexp_extract(p, '\$[A-Za-z0-9_]+') ELSE trim(p) END),
    lambda p: p <> '' AND regexp_matches(p, CASE WHEN ext = '.php' THEN '^\$' ELSE '^{_NAME}$' END)), ',') AS parameters
  FROM (SELECT 'method' AS kind, repo_id, path, ord, base, ext, cname AS parent, mname AS name, seg, n, args FROM methods
    UNION ALL SELECT 'function', repo_id, path, ord, base, ext, '', fname, seg, 0, args FROM function_segs)
), syms AS (
  SELECT repo_id, path, ord, 'class' AS kind, '' AS parent, cname AS name, '' AS parameters FROM class_segs
  UNION ALL SELECT repo_id, path, ord, kind, parent, name, parameters FROM params
  UNION ALL SELECT repo_id, path, ord, 'import', '', imp, '' FROM imports
  UNION ALL SELECT repo_id, path, ord, 'dependency', '', dep, '' FROM deps
), dflows AS (
  SELECT repo_id, path, ord, CASE WHEN kind = 'method' THEN base || '.' || parent ELSE base END AS source, name AS function,
    parameters FROM params
)"""


def over_files(sql: str, *more: str) -> str:
    return ", ".join([ctes("code_files"), FILES, *more]) + " " + sql


def over_symbols(sql: str, *more: str) -> str:
    return over_files(sql, SYMBOLS, *more)
