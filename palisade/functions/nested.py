"""Helpers for nested columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def items(column: Column | str) -> Column:
    """Array to explode, nulls dropped.

    Exploding a bare column makes Catalyst infer a ``size(column) > 0`` filter
    and push it to the scan, which would parse every text a second time; an
    expression is exploded as it is.
    """
    return F.filter(column, lambda x: x.isNotNull())
