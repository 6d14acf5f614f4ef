"""Views derived from the driver's tables.

Each view is a pure function of its tables and is stated once, as SQL that both
Spark and the checking database accept: the text is the view's definition, not
an operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Files with classes that inherit: along chains, over files of one name, in cycles, and from outside.
CLASS_FILES = """
SELECT repo_id, ord, 'm' || CAST(ord % 7 AS STRING) || '/k' || CAST(ord AS STRING) || ext AS path,
  concat_ws(chr(10),
    'import lib/k' || CAST(CAST(floor(ord / 3) AS BIGINT) AS STRING),
    CASE ext
      WHEN '.py' THEN 'class N' || half || '(N' || fifth || ', pkg.Mixin' || CAST(ord % 3 AS STRING) || '[T], metaclass=Meta):' || chr(10) || '    pass'
      ELSE 'class N' || half || ' extends N' || fifth || ' implements Shape, N' || here || ' ' || chr(123) || chr(10) || chr(125) END,
    CASE ext WHEN '.py' THEN 'class N' || here || '(N' || there || '):' || chr(10) || '    pass'
      ELSE 'abstract class N' || here || ' extends lib.N' || there || ' ' || chr(123) || chr(10) || chr(125) END,
    text) AS content
FROM (
  SELECT source AS repo_id, doc_id AS ord, text, CASE lang WHEN 'fr' THEN '.js' WHEN 'de' THEN '.php' ELSE '.py' END AS ext,
    CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) AS half, CAST(CAST(floor(doc_id / 5) AS BIGINT) AS STRING) AS fifth,
    CAST(doc_id % 40 AS STRING) AS here, CAST((doc_id + 13) % 40 AS STRING) AS there
  FROM documents) shaped
"""

CODE_FILES = """
SELECT repo_id, path, content, CAST(length(content) AS BIGINT) AS length, ord FROM (
  SELECT repo_id, ord,
    dir || CASE WHEN ord % 23 = 0 THEN '/d' || num || '/main' ELSE '/' || stem || '_' || num END || ext AS path,
    concat_ws(chr(10),
      CASE ext
        WHEN '.py' THEN concat_ws(chr(10),
          'import pkg_' || CAST(ord % 17 AS STRING) || '.core',
          'from ' || peer || ' import helper',
          'import shared/' || peer,
          'class Service' || num || '(Base):',
          '    def load(self, key):',
          '        return key',
          '',
          '    def save(self, key, value, *rest):',
          '        return value',
          'def handle_' || num || '(' || CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a, b' ELSE 'a, b, c=1' END || '):',
          '    return None',
          CASE WHEN ord % 13 = 0 THEN 'if __name__ == ''__main__'':' || chr(10) || '    run()' END)
        WHEN '.js' THEN concat_ws(chr(10),
          'import helper from lib/' || peer,
          'const store = require(''' || dir || '/' || peer || ''');',
          'class Service' || num || ' extends Base ' || chr(123),
          '  load(key) ' || chr(123),
          '    return key;',
          '  ' || chr(125),
          '  save(key, value) ' || chr(123),
          '    return value;',
          '  ' || chr(125),
          chr(125),
          'function handle_' || num || '(' || CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a, b' ELSE 'a, b, c = 1' END || ') ' || chr(123),
          '  return null;',
          chr(125),
          CASE WHEN ord % 13 = 0 THEN 'exports.handler = handle_' || num || ';' END)
        WHEN '.php' THEN concat_ws(chr(10),
          CASE WHEN ord % 13 = 0 THEN '<?php' ELSE '<?' END,
          'include ''' || dir || '/' || peer || ''';',
          'include lib/' || peer || ';',
          'class Service' || num || ' ' || chr(123),
          '    public function load($key) ' || chr(123),
          '        return $key;',
          '    ' || chr(125),
          '    private static function save($key, array $value = null) ' || chr(123),
          '        return $value;',
          '    ' || chr(125),
          chr(125),
          'function handle_' || num || '(' || CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN '$a' WHEN 2 THEN '$a, $b' ELSE '$a, $b, $c = 1' END || ') ' || chr(123),
          '    return null;',
          chr(125))
        WHEN '.java' THEN concat_ws(chr(10),
          'import shared.' || peer || ';',
          'public class Service' || num || ' ' || chr(123),
          CASE WHEN ord % 13 = 0 THEN '    public static void main(String[] args) ' || chr(123) || chr(125) END,
          chr(125))
      END,
      text) AS content
  FROM (
    SELECT source AS repo_id, doc_id AS ord, CAST(doc_id AS STRING) AS num, text,
      split_part('src/api,lib,app/model,docs,node_modules/x,tests', ',', CAST(doc_id % 6 AS INTEGER) + 1) AS dir,
      split_part('main,auth_login,user_model,db_schema,controller,payment,latest,config,util', ',', CAST(doc_id % 9 AS INTEGER) + 1) AS stem,
      split_part('main,auth_login,user_model,db_schema,controller,payment,latest,config,util', ',', CAST(doc_id % 9 AS INTEGER) + 1)
        || '_' || CAST(doc_id + 180 AS STRING) AS peer,
      CASE WHEN doc_id % 11 = 0 THEN '' WHEN lang = 'en' THEN '.py' WHEN lang = 'fr' THEN '.js'
        WHEN lang = 'de' THEN '.php' WHEN lang = 'es' THEN '.java' ELSE '' END AS ext
    FROM documents
  ) shaped
) files
"""

STAR_FLOWS = """
SELECT substr(CAST(l_shipdate AS STRING), 1, 7) AS repo_id, 'S' || CAST(l_suppkey AS STRING) AS source,
  'O' || CAST(l_orderkey AS STRING) AS function, l_returnflag AS p1, l_linestatus AS p2,
  CAST(l_orderkey AS BIGINT) * 16 + l_linenumber AS ord
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

STAR_EDGES = """
SELECT repo_id, src, dst, min(ord) AS ord FROM (
  SELECT substr(CAST(l_shipdate AS STRING), 1, 7) AS repo_id, 'S' || CAST(l_suppkey AS STRING) AS src,
    'C' || CAST(o_custkey AS STRING) AS dst, CAST(l_orderkey AS BIGINT) * 16 + l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
) linked GROUP BY repo_id, src, dst
"""

# Every flow with the customer it leads to: star_flows and star_edges in one pass over their tables.
STAR_LINKS = """
SELECT substr(CAST(l_shipdate AS STRING), 1, 7) AS repo_id, 'S' || CAST(l_suppkey AS STRING) AS source,
  'O' || CAST(l_orderkey AS STRING) AS function, l_returnflag AS p1, l_linestatus AS p2,
  CAST(l_orderkey AS BIGINT) * 16 + l_linenumber AS ord, 'C' || CAST(o_custkey AS STRING) AS dst
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

STAR_MEMBERS = """
SELECT r_name AS boundary, 'S' || CAST(s_suppkey AS STRING) AS member, CAST(n_nationkey AS BIGINT) AS ord
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT r_name AS boundary, 'C' || CAST(c_custkey AS STRING) AS member, CAST(n_nationkey AS BIGINT) AS ord
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

STAR_BOUNDARIES = """
SELECT r_name AS boundary, 'Region ' || CAST(r_regionkey AS STRING) || ' zone' AS description FROM region
"""

STAR_THREATS = """
SELECT 'R' || CAST(FLOOR(event_id / 4) AS BIGINT) AS repo_id,
  CASE CAST(FLOOR(event_id / 4) AS BIGINT) % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'flow' ELSE 'vulnerability' END AS owner_kind,
  'U' || CAST(user_id AS STRING) AS owner,
  event_id AS ordinal, event_type AS type, 'value ' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) AS description,
  CASE event_type WHEN 'error' THEN 'High' WHEN 'purchase' THEN 'Medium' WHEN 'signup' THEN 'medium'
    WHEN 'click' THEN 'Low' ELSE 'bogus' END AS raw_severity,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'impact ' || event_type END AS impact,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'review ' || event_type END AS mitigation,
  CASE WHEN event_type = 'error' THEN props END AS code_snippet,
  event_id % 2 = 0 AS crosses_boundary
FROM events
"""

RESPONSES = """
SELECT d.doc_id AS response_id, d.source AS repo_id,
  CASE d.doc_id % 3
    WHEN 0 THEN concat_ws(chr(10),
      'Type: Tampering', 'Description: ' || d.text, 'Severity: ' || sev,
      CASE WHEN d.doc_id % 2 = 0 THEN 'Impact: data loss: partial' END,
      'Mitigation: validate input', 'Mitigation: validate and encode', '',
      'Type: Spoofing', 'Severity: ' || CASE WHEN quality = 1 THEN 'medium' ELSE 'severe' END, 'Code Snippet: run(x)')
    WHEN 1 THEN concat_ws(chr(10),
      'Preface: none', 'Impact: exposed records', '', '  ', d.text, '',
      '  TYPE :  Information Disclosure  ', 'Severity: ' || sev, '', '',
      'Description: orphan block', '', 'Type: Repudiation')
    ELSE concat_ws(chr(10),
      '- Type: Ignored', '- Severity: High', '', d.text, '', 'Type: Elevation', 'Description: ' || d.lang, '')
  END AS text
FROM (
  SELECT doc_id, source, text, lang, quality, CASE WHEN toxic = 1 THEN 'High' WHEN quality = 1 THEN 'Low' ELSE 'Critical' END AS sev
  FROM documents LEFT JOIN (SELECT doc_id AS label_doc, quality, toxic FROM labels) l ON label_doc = doc_id
) d
"""

ANALYSES = """
SELECT d.doc_id AS response_id, d.source AS repo_id,
  'Answer' || chr(10) || 'Purpose: ' || d.text || chr(10) || chr(10)
  || 'Key Functions: ' || chr(10) || '- load_' || CAST(d.doc_id AS STRING) || chr(10) || '- save, close' || chr(10) || chr(10)
  || CASE WHEN quality = 1 THEN 'Dependencies: auth login db' || chr(10) || '-- os --' || chr(10) || chr(10) ELSE '' END
  || 'Security Considerations: ' || CASE WHEN toxic = 1 THEN 'escape output' ELSE '' END AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

BOUNDARY_ANSWERS = """
SELECT d.doc_id AS response_id, d.source AS repo_id,
  'DESCRIPTION: ' || CASE WHEN quality = 1 THEN d.text ELSE 'short' END || chr(10) || chr(10)
  || CASE WHEN d.doc_id % 20 IN (7, 13) THEN 'No zones:' ELSE 'SECURITY_BOUNDARIES:' END || chr(10)
  || '- Web ' || d.lang || ': handles ' || CAST(d.n_chars AS STRING) || ' items' || chr(10)
  || '- Storage: keeps: ' || repeat('x', CAST(d.doc_id % 5 AS INTEGER)) || chr(10)
  || 'no bullet: skipped' || chr(10) || '- no colon here' || chr(10) || chr(10)
  || 'FILES_BY_BOUNDARY:' || chr(10)
  || '- Web ' || d.lang || ': a' || CAST(d.doc_id % 7 AS STRING) || '.py, b.py,, c' || CAST(d.doc_id AS STRING) || '.py' || chr(10)
  || '- Storage: store.py' || chr(10)
  || '- Web fr: late' || CAST(d.doc_id % 3 AS STRING) || '.js' || chr(10)
  || '- Unheard: lost.py' || chr(10) AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

VULNERABILITY_ANSWERS = """
SELECT d.doc_id AS response_id, d.source AS repo_id,
  CASE d.doc_id % 4
    WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[' || item || ', ' || item2 || ']' || chr(10) || '```'
    WHEN 1 THEN '[' || item || ']'
    WHEN 2 THEN '[' || item || ', ' || chr(123) || '"type": '
    ELSE item
  END AS text
FROM (
  SELECT doc_id, source,
    chr(123) || '"type": "leak ' || lang || '", "description": "passes ' || CAST(n_chars AS STRING) || ' chars", "severity": "High", '
    || '"components": ["c' || CAST(doc_id AS STRING) || '", "shared"], "attack_vector": "network", "mitigation": "encrypt"' || chr(125) AS item,
    chr(123) || '"type": "race", "severity": "Low", "components": []' || chr(125) AS item2
  FROM documents
) d
"""

VIEWS = {
    "class_files": CLASS_FILES,
    "code_files": CODE_FILES,
    "star_flows": STAR_FLOWS,
    "star_edges": STAR_EDGES,
    "star_links": STAR_LINKS,
    "star_members": STAR_MEMBERS,
    "star_boundaries": STAR_BOUNDARIES,
    "star_threats": STAR_THREATS,
    "responses": RESPONSES,
    "analyses": ANALYSES,
    "boundary_answers": BOUNDARY_ANSWERS,
    "vulnerability_answers": VULNERABILITY_ANSWERS,
}

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


# Tables that are expensive to process row by row, with the key that spreads them.
_SPREAD = {"documents": "doc_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _SPREAD[name]) if name in _SPREAD else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input of few splits; an input of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, keys: list[str], rows: int = 1 << 18) -> DataFrame:
    """Deal rows by ``keys`` to as many tasks as keep about ``rows`` each, so that what a task sorts does not grow with the input.

    An input of at most ``rows`` for every core is left as it is. The rows are counted first: for inputs that are counted for
    little. There are as many tasks as other shuffles have at least, for a join would deal the rows once more otherwise.
    """
    count, session = df.count(), df.sparkSession
    if count <= rows * session.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-count // rows)), *keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame, without registering anything in the catalog."""
    sql = VIEWS[name]
    used = [t for t in _TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    inputs = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in used)
    return spark.sql(f"WITH {inputs} {sql}", **{t: table(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """``WITH`` clause that states the named views for the checking database."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
