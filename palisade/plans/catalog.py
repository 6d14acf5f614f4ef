"""All registered queries and their checking SQL."""

from __future__ import annotations

from . import class_queries, corpus_queries, drawing_queries, model_queries, small_queries, text_queries, vector_queries

AREAS = [corpus_queries, text_queries, vector_queries, model_queries, class_queries, small_queries, drawing_queries]

QUERIES = {name: fn for area in AREAS for name, fn in area.QUERIES.items()}
ORACLE = {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
