"""Exact nearest neighbours that leave out what the triangle inequality rules out.

Pivots, fitted on a bounded sample, cut the corpus into cells; every row knows
its distance to the pivot of its cell.  A query first searches the nearest cells
that hold enough rows, which bounds the distance of its neighbours, and then
only those cells, and in them only those rows, that can lie within the bound.
Vectors of the corpus travel to the cells that some query visits; a query
travels to the cells it visits, not to all blocks of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import first_per_group
from ..session import stage
from .vectors import BLOCK_ROWS, DISTANCE_DIGITS, _matrix

PIVOTS, SAMPLE_ROWS, ROUNDS = 64, 4096, 8
QUERY_ROWS = 1 << 16


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices, one row of ``b`` at a time: no intermediate is larger than ``a``."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))


def usable(df: DataFrame) -> DataFrame:
    """Vectors as doubles; those that are null, empty or hold null or non-finite components take no part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    vectors = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return vectors.filter(F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))


def fit_pivots(corpus: DataFrame, count: int = PIVOTS, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of ``count`` groups of at most ``sample`` rows, those with the smallest checksums of their ids.

    Results do not depend on the pivots, only how much is left out does.
    """
    drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()
    if drawn.empty:
        return np.zeros((0, 0))
    rows = _matrix(drawn["embedding"])
    pivots = np.unique(rows[:count], axis=0)
    for _ in range(ROUNDS):
        nearest = _apart(rows, pivots).argmin(axis=1)
        pivots = np.stack([rows[nearest == p].mean(axis=0) if (nearest == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def knn_pivots(queries: DataFrame, corpus: DataFrame, k: int, pivots: np.ndarray | None = None) -> DataFrame:
    """``(query_id, id, distance, rank)``: exact k nearest neighbours by squared L2 distance, ties by id.

    ``queries(query_id, embedding)``, ``corpus(id, embedding)`` with vectors of one length and distinct ids.
    """
    found, _ = pivot_search(queries, corpus, k, pivots)
    return found


def pivot_search(
    queries: DataFrame, corpus: DataFrame, k: int, pivots: np.ndarray | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Neighbours as in :func:`knn_pivots`, and ``(query_id, measured)``: to how many rows each query was measured."""
    queries, corpus = usable(queries).select("query_id", "embedding"), usable(corpus).select("id", "embedding")
    centres = fit_pivots(corpus) if pivots is None else pivots
    ident = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (corpus, "id"))}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                away = _apart(_matrix(pdf["embedding"]), centres)
                yield pdf.assign(cell=away.argmin(axis=1).astype(np.int32), radius=away.min(axis=1))

    cells = stage(corpus.mapInPandas(assign, f"id {ident['id']}, embedding array<double>, cell int, radius double"), "pivot-cells")
    # One row for each pivot.
    seen = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).toPandas()
    n, low, high = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    n[seen["cell"]], low[seen["cell"]], high[seen["cell"]] = seen["n"], seen["low"], seen["high"]
    blocks = np.maximum(-(-n // block_rows), 1)
    parts = max(1, -(-queries.count() // query_rows))
    schema = f"query_id {ident['query_id']}, embedding array<double>, cell int, away double, bound double"

    def visit(first: bool):
        def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(centres):
                    continue
                away = _apart(_matrix(pdf["embedding"]), centres)
                order = np.argsort(np.where(n > 0, away, np.inf), axis=1, kind="stable")
                held = np.take_along_axis(np.broadcast_to(n, away.shape), order, axis=1)
                opening = np.zeros(away.shape, bool)
                np.put_along_axis(opening, order, held.cumsum(axis=1) - held < k, axis=1)
                bound = pdf["bound"].to_numpy()
                least = np.maximum(np.maximum(away - high, low - away), 0)
                wanted = opening if first else ~opening & (least <= bound[:, None])
                q, c = np.nonzero(wanted & (n > 0))
                yield pd.DataFrame({
                    "query_id": pdf["query_id"].to_numpy()[q], "embedding": pdf["embedding"].to_numpy()[q], "cell": c.astype(np.int32),
                    "away": away[q, c], "bound": bound[q],
                })
        return cells_of

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            order = np.argsort(right["id"].to_numpy(), kind="stable")
            ids, vectors, radius = right["id"].to_numpy()[order], _matrix(right["embedding"])[order], right["radius"].to_numpy()[order]
            for qid, q, away, bound in zip(left["query_id"], left["embedding"], left["away"], left["bound"], strict=True):
                rows = np.flatnonzero(np.abs(radius - away) <= bound)
                d = np.round(((vectors[rows] - q) ** 2).sum(axis=1), DISTANCE_DIGITS)
                best = np.argsort(d, kind="stable")[:k]
                # A row without an id tells how many rows were measured.
                out.append(pd.DataFrame({"query_id": qid, "id": [*ids[rows[best]], None], "distance": [*d[best], float(len(rows))]}, dtype=object))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": []}, dtype=object)

    def search(bounded: DataFrame, first: bool) -> DataFrame:
        block_count = F.element_at(F.array(*[F.lit(int(b)) for b in blocks] or [F.lit(1)]), F.col("cell") + 1)
        asked = (
            bounded.mapInPandas(visit(first), schema)
            .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), block_count - 1)))
        )
        asked = stage(asked, "pivot-visits")
        keys = ["cell", "block", "part"]
        needed = asked.select("cell", "block", F.col("part").alias("for")).distinct()
        placed = cells.withColumn("block", F.pmod(F.xxhash64("id"), block_count).cast("int")).join(needed, ["cell", "block"])
        held = placed.select("id", "embedding", "radius", "cell", "block", (F.col("for") + 0).alias("part"))
        out = f"query_id {ident['query_id']}, id {ident['id']}, distance double"
        return stage(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(measure, out), "pivot-found")

    near = [F.asc("distance"), F.asc("id")]
    opened = search(queries.withColumn("bound", F.lit(float("inf"))), True)
    kept = first_per_group(opened.filter("id IS NOT NULL"), ["query_id"], near, k)
    # Distances are rounded, so the bound allows for that.
    reach = kept.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance") + 1e-6) * (1 + 1e-9) + 1e-6).otherwise(float("inf")).alias("bound")
    )
    further = search(queries.join(reach, "query_id").select("query_id", "embedding", "bound"), False)
    every = opened.unionByName(further)
    found = first_per_group(kept.drop("rank").unionByName(further.filter("id IS NOT NULL")), ["query_id"], near, k)
    return found, every.filter("id IS NULL").groupBy("query_id").agg(F.sum("distance").cast("long").alias("measured"))
