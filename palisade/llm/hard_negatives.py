"""Hard negatives of anchor vectors: exact integer scores by Strassen's multiplication, best rows kept in mergeable heaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import only, rows_below, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
# A negative's score lies between this share (percent) of its positive's score and that score.
SHARE = 80
# Anchors that travel to the tasks at once, and the tiles that are multiplied: so many anchors by so many rows.
PASS_ANCHORS, TILE_ANCHORS, TILE_ROWS = 8192, 512, 2048
# A side of a product from which on the recursion stops.
LEAF = 8

ROW = "uid long, vec_id long, tie long, label long, size int, values array<long>"
ENTRY = "slot int, score long, unnamed boolean, vec_id long, tie long, uid long"


class Rows(NamedTuple):
    """Rows of one vector length."""

    uid: np.ndarray
    vec_id: np.ndarray
    unnamed: np.ndarray
    tie: np.ndarray
    label: np.ndarray
    values: np.ndarray  # rows x components

    def take(self, at) -> Rows:
        return Rows(*(c[at] for c in self))


class Heap(NamedTuple):
    """The best entries of every slot, best first. Heaps merge by :func:`merged`."""

    slot: np.ndarray
    score: np.ndarray
    unnamed: np.ndarray
    vec_id: np.ndarray
    tie: np.ndarray
    uid: np.ndarray


EMPTY = Heap(*(np.zeros(0, bool if c == "unnamed" else "i8") for c in Heap._fields))


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` over 64-bit integers by Strassen's recursion: seven products of halves, odd sides padded by zeros.

    Additions and products are exact modulo 2^64, so the result is exact whenever it fits, whatever the steps between hold.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        return a @ b
    if rows % 2 or inner % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    if inner % 2 or columns % 2:
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    r, i, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    both, low_left, right, left = multiply(a11 + a22, b11 + b22), multiply(a21 + a22, b11), multiply(a11, b12 - b22), multiply(a22, b21 - b11)
    top, below, beside = multiply(a11 + a12, b22), multiply(a21 - a11, b11 + b12), multiply(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = both + left - top + beside
    out[:r, c:] = right + top
    out[r:, :c] = low_left + left
    out[r:, c:] = both - low_left + right + below
    return out[:rows, :columns]


def merged(one: Heap, other: Heap, most: int) -> Heap:
    """The first ``most`` entries of every slot: higher scores first, then smaller ids, null last."""
    both = Heap(*(np.concatenate(c) for c in zip(one, other, strict=True)))
    order = np.lexsort((both.uid, both.tie, both.vec_id, both.unnamed, ~both.score, both.slot))
    slot = both.slot[order]
    first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
    rank = np.arange(len(slot)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(slot) else slot
    return Heap(*(c[order[rank < most]] for c in both))


def floors(heap: Heap, slots: int, most: int, least: np.ndarray) -> np.ndarray:
    """For every slot the score below which nothing more enters: that of its last entry once it is full."""
    found = least.copy()
    full = np.flatnonzero(np.bincount(heap.slot, minlength=slots) == most)
    last = np.searchsorted(heap.slot, full, "right") - 1
    found[full] = np.maximum(found[full], heap.score[last])
    return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows of one length at a time, at most ``TILE_ROWS``."""
    for batch in rows_below(batches, TILE_ROWS):
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == size))
            values = own.column("values").flatten().to_numpy().reshape(own.num_rows, size)
            ids = own.column("vec_id")
            yield Rows(
                own.column("uid").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                own.column("tie").to_numpy(), own.column("label").to_numpy(), values,
            )


def entries(slot: np.ndarray, score: np.ndarray, rows: Rows, at: np.ndarray) -> Heap:
    return Heap(slot, score, rows.unnamed[at], rows.vec_id[at], rows.tie[at], rows.uid[at])


def positives_of(anchors: dict[int, tuple[np.ndarray, Rows]], slots: int, most: int) -> Callable:
    """Task function: the best rows of every anchor's own label. ``anchors`` are (slots, rows) by vector length."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, least = EMPTY, np.full(slots, np.iinfo("i8").min)
        for rows in blocks(batches):
            slot, own = anchors.get(rows.values.shape[1], (None, None))
            if own is None:
                continue
            floor = floors(heap, slots, most, least)
            new = [heap]
            for label in np.intersect1d(own.label, rows.label).tolist():
                near = rows.take(np.flatnonzero(rows.label == label))
                mine = np.flatnonzero(own.label == label)
                for at in range(0, len(mine), TILE_ANCHORS):
                    part = mine[at : at + TILE_ANCHORS]
                    score = multiply(own.values[part], near.values.T)
                    i, j = np.nonzero((score >= floor[slot[part]][:, None]) & (own.uid[part][:, None] != near.uid))
                    new.append(entries(slot[part][i], score[i, j], near, j))
            heap = merged(Heap(*(np.concatenate(c) for c in zip(*new, strict=True))), EMPTY, most)
        yield as_batch(heap)

    return find


def negatives_of(anchors: dict[int, tuple[np.ndarray, Rows]], low: np.ndarray, high: np.ndarray, most: int) -> Callable:
    """Task function: the best rows of other labels in every window. ``low`` and ``high``: anchors x positives, the bounds of
    the scores; a window without a positive has ``low`` above ``high``."""
    wide = low.shape[1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = EMPTY
        for rows in blocks(batches):
            slot, own = anchors.get(rows.values.shape[1], (None, None))
            if own is None:
                continue
            # At once bounds what waits: no more than a tile's scores for each window.
            for at in range(0, len(slot), TILE_ANCHORS):
                part = slice(at, at + TILE_ANCHORS)
                floor = floors(heap, low.size, most, low.ravel()).reshape(low.shape)[slot[part]]
                ceiling = high[slot[part]]
                score = multiply(own.values[part], rows.values.T)
                inside = (score >= floor.min(axis=1)[:, None]) & (score <= ceiling.max(axis=1)[:, None]) & (own.label[part][:, None] != rows.label)
                i, j = np.nonzero(inside)
                found = score[i, j]
                new = [heap]
                for k in range(wide):
                    fits = (found >= floor[i, k]) & (found <= ceiling[i, k])
                    new.append(entries(slot[part][i[fits]] * wide + k, found[fits], rows, j[fits]))
                heap = merged(Heap(*(np.concatenate(c) for c in zip(*new, strict=True))), EMPTY, most)
        yield as_batch(heap)

    return find


def as_batch(heap: Heap) -> pa.RecordBatch:
    columns = [pa.array(heap.slot.astype("i4")), *(pa.array(np.ascontiguousarray(c)) for c in heap[1:])]
    return pa.RecordBatch.from_arrays(columns, list(Heap._fields))


def best_of_tasks(found: DataFrame, most: int) -> DataFrame:
    """Merge the heaps of all tasks: ``most`` entries a slot, with their ``rank``. Ranks above are cut before the sort."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "unnamed", "vec_id", "tie", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def scored_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``ROW`` of every row that takes part, its components as integers, under a number of its own; written once."""
    rows = only(vectors, vec_id=f"{id_col}:long", label=f"{label_col}:long", vector=f"{vec_col}:array<double>")
    widest = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size("vector"), F.lit(1))))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < widest))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(usable)
    values = F.transform("vector", lambda x: F.floor(x * SCALE))
    return written(
        rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.xxhash64("label", "vector").alias("tie"), "label", F.size("vector").alias("size"), values.alias("values")),
        "hard-negatives-rows",
    )


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, pass_anchors: int = PASS_ANCHORS,
) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row for which ``is_anchor`` (a
    predicate on ``vec_id``) holds, its first ``positives`` other rows of the same label; for each of them the first
    ``negatives`` rows of other labels whose score is at most the positive's and at least ``share`` percent of it. A score is
    the inner product of the components, each floor(256 x); higher ones come first, equal ones by smaller id.

    Rows stay where they are. Anchors travel to them in passes of at most ``pass_anchors``, so no table of unbounded size is
    sent or held; each pass reads the integer rows twice, once for positives, which fix the windows, and once for negatives.
    A task multiplies tiles of anchors and rows and keeps a heap for every anchor (and window); only heaps are shuffled, and
    the heaps of all tasks merge into one. Every pass is written, so that a lost executor costs the tasks it ran.

    Null labels and vectors, null or non-finite components take no part, nor do components so large (beyond 2^31 / sqrt(length),
    times 1/256) that a score might not fit 64 bits. Vectors of different lengths never meet, empty ones score 0. Rows that repeat an id are rows
    of their own, equal scores of them come in a fixed order; a null id comes last among equals. No positive, no rows; an
    empty table gives an empty result; other columns are not carried along.
    """
    spark = vectors.sparkSession
    rows = scored_rows(vectors, id_col, vec_col, label_col)
    anchors = written(rows.filter(is_anchor), "hard-negatives-anchors")
    found, after = [], -1
    while after is not None:
        some = anchors.filter(F.col("uid") > after).orderBy("uid").limit(pass_anchors).toArrow()
        found.append(written(pass_rows(rows, some, positives, negatives, share), "hard-negatives"))
        after = some.column("uid")[-1].as_py() if some.num_rows == pass_anchors else None
    return spark.read.schema(found[0].schema).parquet(*(path for part in found for path in part.inputFiles())) if len(found) > 1 else found[0]


def pass_rows(rows: DataFrame, some: pa.Table, positives: int, negatives: int, share: int) -> DataFrame:
    """Hard negatives of the anchors in ``some``, a bounded table."""
    spark = rows.sparkSession
    slots = some.num_rows
    anchors = {}
    for batch in some.combine_chunks().to_batches():
        for own in blocks(iter([batch])):
            at = np.searchsorted(some.column("uid").to_numpy(), own.uid)
            size = own.values.shape[1]
            known = anchors.get(size)
            anchors[size] = (at, own) if known is None else (np.r_[known[0], at], Rows(*(np.concatenate(c) for c in zip(known[1], own, strict=True))))

    best = best_of_tasks(rows.mapInArrow(positives_of(anchors, slots, positives), ENTRY), positives).select("slot", "rank", "score", "unnamed", "vec_id").toArrow()
    # At most ``positives`` rows an anchor.
    high = np.full((slots, positives), np.iinfo("i8").min)
    low = np.full((slots, positives), np.iinfo("i8").max)
    at = (best.column("slot").to_numpy(), best.column("rank").to_numpy() - 1)
    score = best.column("score").to_numpy()
    # 100 n >= share p, without a product that might not fit.
    high[at], low[at] = score, score - ((100 - share) * (score // 100) + (100 - share) * (score % 100) // 100)
    found = best_of_tasks(rows.mapInArrow(negatives_of(anchors, low, high, negatives), ENTRY), negatives)
    ids = some.column("vec_id").to_pylist()
    known = [
        (s * positives + r - 1, ids[s], None if unnamed else vec_id, score)
        for s, r, score, unnamed, vec_id in zip(*(best.column(c).to_pylist() for c in ("slot", "rank", "score", "unnamed", "vec_id")), strict=True)
    ]
    pairs = spark.createDataFrame(known, "slot int, anchor_id long, positive_id long, positive_score long")
    return found.join(pairs, "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.when(~F.col("unnamed"), F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
