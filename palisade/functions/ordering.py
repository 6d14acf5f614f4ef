"""Exact per-group positions and caps that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import session


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows of every group, with their 1-based rank.

    For displays: Catalyst plans a partial group limit, so a hot group ships at
    most ``limit`` rows per input partition. Whole groups are numbered by
    :func:`with_position`.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, name: str, tier: str | None = None, width: int = 1 << 16,
    then: Sequence[str] = (),
) -> DataFrame:
    """Add the 1-based position of each row in its group, ordered by (tier, order).

    ``order`` is an integer that is unique within a group, or is so together with
    the columns ``then``.  Rows are cut into ranges of ``width`` order values; a position is the row's rank inside its
    range plus the sizes of the earlier ranges.  Only the range *counts* of a
    group meet in one task, so a group may hold any share of the rows.
    """
    tiers = [tier] if tier else []
    sliced, cells = _sliced(df, keys, tiers, order, width)
    return _placed(sliced, _starts(sliced, keys, cells), cells, order, name, then)


def staged_positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str, tier: str, then: Sequence[str], size: str,
    unfold: Callable[[DataFrame], DataFrame], columns: Sequence[str],
) -> DataFrame:
    """The ``columns`` of :func:`with_position` for rows that stand for as many rows as their ``size`` says, staged.

    Rows travel as they are and become those that are numbered, by ``unfold``, which keeps keys, tier, order and ``__slot``, where
    they arrive.  The ranges of a large table are numbered in rounds, so that only a round's rows are shuffled at a time.
    """
    sliced, cells = _sliced(df, keys, [tier], order, 1 << 16)
    starts = session.stage_parts([_starts(sliced, keys, cells, size)], "starts")
    rounds = session.rounds(starts.agg(F.sum("__n")).first()[0] or 0, 6)

    def numbered(r: int) -> DataFrame:
        here = session.in_round(r, rounds, *cells)
        rows = unfold(sliced.drop(size).filter(here).repartition(*cells))
        return _placed(rows, starts.filter(here), cells, order, name, then).select(*columns)

    staged = session.stage_parts([numbered(r) for r in range(rounds)], "numbered")
    session.unstage(starts)
    return staged


_SLOT, _OFFSET = "__slot", "__offset"


def _sliced(df: DataFrame, keys: Sequence[str], tiers: Sequence[str], order: str, width: int) -> tuple[DataFrame, list[str]]:
    """Rows with their range of order values, and the columns that name a range of a group."""
    return df.withColumn(_SLOT, F.floor(F.col(order) / F.lit(width))), [*keys, *tiers, _SLOT]


def _starts(sliced: DataFrame, keys: Sequence[str], cells: Sequence[str], size: str | None = None) -> DataFrame:
    """Rows in every range (``__n``) and in the earlier ranges of its group."""
    before = Window.partitionBy(*keys).orderBy(*cells[len(keys):]).rowsBetween(Window.unboundedPreceding, -1)
    count = F.count(F.lit(1)) if size is None else F.sum(size)
    return (
        sliced.groupBy(*cells)
        .agg(count.alias("__n"))
        .select(*cells, "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_OFFSET))
    )


def _placed(sliced: DataFrame, starts: DataFrame, cells: Sequence[str], order: str, name: str, then: Sequence[str]) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(order, *then))
    return (
        sliced.withColumn(name, inside)
        .join(starts.drop("__n"), cells)
        .withColumn(name, (F.col(name) + F.col(_OFFSET)).cast("long"))
        .drop(_SLOT, _OFFSET)
    )
