"""Truncation of contexts, objects in answers, and ids of paths, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, text as X
from ..operators import graph as G
from .corpus_queries import code_files
from .views import ctes, table

# Tokens of a context, and those that its prompt may have.
CONTEXT_TOKENS = 300


def truncated_texts(spark, d):
    """Every text cut in its middle, cut to a token budget, and cut at its end, as checksums."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", F.floor(F.length("text") / 4 + 1).alias("tokens"))
    return docs.select(
        "ord", F.md5(X.truncate_middle("text")).alias("middle_md5"), F.md5(X.truncate_to_budget("text", "tokens", CONTEXT_TOKENS)).alias("budget_md5"),
        F.md5(X.truncate_context("text")).alias("context_md5"),
    )


def answer_objects(spark, d):
    """The JSON object of every answer that wraps an event's properties; null where it is cut off or where there are two."""
    props, kind = F.coalesce("props", F.lit("")), F.col("event_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("Here it is:\n"), props, F.lit("\nDone."))).when(kind == 1, props).when(
        kind == 2, F.concat(F.lit("{"), props)
    ).otherwise(F.concat(props, F.lit("\n"), props))
    return table(spark, d, "events").select(F.col("event_id").alias("answer_id"), F.coalesce(X.json_object(answer), F.lit("none")).alias("object"))


def path_ids(spark, d):
    """Diagram ids of all paths, and how many paths of a repository share one."""
    ids = code_files(spark, d).select("repo_id", G.path_node_id("path").alias("node_id"))
    return ids.groupBy("repo_id", "node_id").agg(F.count(F.lit(1)).alias("paths"))


QUERIES = {"truncated_texts": truncated_texts, "answer_objects": answer_objects, "path_ids": path_ids}

_MARK = K.MIDDLE_MARK.replace("\n", "' || chr(10) || '")
ORACLE = {
    "truncated_texts": f"""
WITH sized AS (SELECT doc_id AS ord, text, length(text) AS n, CAST(floor(length(text) / 4 + 1) AS BIGINT) AS tokens FROM documents),
kept AS (SELECT *, floor(n * (CAST({CONTEXT_TOKENS} AS DOUBLE) / tokens) * CAST(0.7 AS DOUBLE)) AS kept FROM sized),
ends AS (SELECT *, CAST(floor(kept * CAST(0.6 AS DOUBLE)) AS BIGINT) AS head, CAST(floor(kept * CAST(0.4 AS DOUBLE)) AS BIGINT) AS tail FROM kept)
SELECT ord, md5(CASE WHEN n > 2000 THEN substr(text, 1, 1000) || '{_MARK}' || substr(text, n - 999) ELSE text END) AS middle_md5,
  md5(CASE WHEN tokens > {CONTEXT_TOKENS} AND n > 0 AND kept < n AND head + tail < n
    THEN substr(text, 1, head) || '{_MARK}' || CASE WHEN tail = 0 THEN text ELSE substr(text, n - tail + 1) END ELSE text END) AS budget_md5,
  md5(CASE WHEN n > {K.CONTEXT_CHARS} THEN substr(text, 1, {K.CONTEXT_CHARS}) || '{K.TRUNCATED_MARK}' ELSE text END) AS context_md5
FROM ends""",
    "answer_objects": r"""
SELECT answer_id, CASE WHEN object <> '' AND json_valid(object) THEN object ELSE 'none' END AS object FROM (
  SELECT event_id AS answer_id, regexp_extract(CASE event_id % 4 WHEN 0 THEN 'Here it is:' || chr(10) || p || chr(10) || 'Done.' WHEN 1 THEN p
    WHEN 2 THEN '{' || p ELSE p || chr(10) || p END, '(?s)\{.*\}', 0) AS object
  FROM (SELECT event_id, coalesce(props, '') AS p FROM events))""",
    "path_ids": ctes("code_files") + " SELECT repo_id, translate(path, '/.', '__') AS node_id, count(*) AS paths FROM code_files GROUP BY 1, 2",
}
