"""Nearest neighbours by inner product: randomly rotated one-bit codes, with error bounds that choose what is reranked."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

K, SEED = 20, 11
# Rows per block of candidates and of queries; a pair of blocks is one unit of work.
CANDIDATE_ROWS, QUERY_ROWS = 4096, 1024
# Width of the error bound in standard deviations of the estimate: at 2.5 about one upper bound in 160 fails, and only a
# neighbour whose own bound fails can be missed.
EPSILON = 2.5


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of vectors: (packed signs after rotation, lengths, correction scalars).

    The correction is the inner product of a unit vector with its code, the corner of a cube on the unit sphere.
    """
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ turn
    bits = turned > 0
    fit = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), norms, fit


def estimate(codes: np.ndarray, norms: np.ndarray, fit: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x rows) and the widths of their error bounds.

    <q, o> is estimated without bias as <q, code> / <o, code>; its error is |q| sqrt((1 - f^2) / f^2) / sqrt(size - 1) times
    a standard normal, about, where f is the correction.
    """
    size = queries.shape[1]
    corners = (np.unpackbits(codes, axis=1, count=size).astype("f4") * 2 - 1) / np.float32(np.sqrt(size))
    scale = norms / fit
    found = ((queries @ turn).astype("f4") @ corners.T) * scale.astype("f4")
    slack = norms * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(1, size - 1))
    return found, np.linalg.norm(queries, axis=1)[:, None] * slack * EPSILON + 1e-5


def dots(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order whatever the number of rows."""
    return (rows * query).sum(axis=1)


def search_block(
    ids: np.ndarray, vectors: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray], query_ids: np.ndarray, queries: np.ndarray,
    turn: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of a block for every query: (query ids, row ids, exact inner products).

    The rows with the best estimates are computed first; their k-th exact value is a floor, and every other row whose upper
    bound reaches it is computed as well.
    """
    guess, slack = estimate(*code, queries, turn)
    out_q, out_id, out_score = [], [], []
    for q, query in enumerate(queries):
        guess_q, other = guess[q], ids != query_ids[q]
        first = np.argpartition(-guess_q, min(2 * k, len(ids) - 1))[: 2 * k + 1]
        first = first[other[first]]
        exact = dots(vectors[first], query)
        floor = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
        reach = other & (guess_q + slack[q] >= floor)
        reach[first] = False
        more = np.flatnonzero(reach)
        rows = np.concatenate([first, more])
        scores = np.concatenate([exact, dots(vectors[more], query)])
        best = np.lexsort((ids[rows], -scores))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_id.append(ids[rows[best]])
        out_score.append(scores[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec``: rows with an id and a vector of finite components that are not all zero."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    limit = float("inf")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def blocks(df: DataFrame, rows: int, seed: int | None) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length of a partition: ``size, ids, vectors`` and, with a seed, ``codes, norms, fit``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}

        def block(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            size = vectors.shape[1]
            cells = [ids.tobytes(), vectors.tobytes()]
            if seed is not None:
                if size not in turns:
                    turns[size] = rotation(size, seed)
                codes, norms, fit = encode(vectors, turns[size])
                cells += [codes.tobytes(), norms.tobytes(), fit.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names)

        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            all_ids, lists = batch.column("vec_id").to_numpy(), batch.column("vec")
            lengths = lists.value_lengths().to_numpy()
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                held_ids, held_vectors = held.setdefault(size, ([], []))
                held_ids.append(all_ids[own])
                held_vectors.append(lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, size))
                n = sum(map(len, held_ids))
                while n >= rows:
                    ids, vectors = np.concatenate(held_ids), np.concatenate(held_vectors)
                    yield block(ids[:rows], np.ascontiguousarray(vectors[:rows]))
                    held_ids[:], held_vectors[:], n = [ids[rows:]], [vectors[rows:]], n - rows
        for held_ids, held_vectors in held.values():
            if sum(map(len, held_ids)):
                yield block(np.concatenate(held_ids), np.ascontiguousarray(np.concatenate(held_vectors)))

    names = ["size", "ids", "vectors"] + (["codes", "norms", "fit"] if seed is not None else [])
    return df.mapInArrow(build, ", ".join(["size int", *(f"{n} binary" for n in names[1:])]))


def search(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", k: int = K,
    candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED,
) -> DataFrame:
    """The ``k`` nearest rows of ``df`` for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Nearest is the largest inner product in double precision; a query's own row is no candidate; ties go to the smaller id.
    The index (codes and scalars of all rows, in blocks) is written to shared storage. Every block of queries meets every
    block of candidates in a task of its own; a task scans one-bit codes and reranks only rows whose error bound can reach the
    k nearest so far, however many those are, so ties and copies are never cut off. A query keeps k rows per block.

    Vectors of one length are a set of their own: a query's candidates are the rows as long as itself. Vectors that are null,
    empty, zero, or hold a null or non-finite component take no part; with fewer than k candidates all are returned; repeated ids are separate candidates; an empty table gives an empty result;
    other columns are not carried along.
    """
    spark = df.sparkSession
    schema = "query_id long, vec_id long, score double"
    asked = written(blocks(valid_vectors(queries, id_col, vec_col).repartition(1 + queries.count() // query_rows), query_rows, None), "ann-queries")
    numbered = asked.select(F.monotonically_increasing_id().alias("at"), F.col("size").alias("query_size"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    numbered = written(numbered, "ann-query-blocks")
    places: dict[int, list[int]] = {}  # one number per block of queries, by length
    for r in numbered.select("query_size", "at").collect():
        places.setdefault(r["query_size"], []).append(r["at"])
    if not places:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    candidates = valid_vectors(df, id_col, vec_col).filter(F.size("vec").isin(*places))  # other lengths need no codes
    index = written(blocks(candidates, candidate_rows, seed), "ann-index")
    met = reduce(lambda rest, p: F.when(F.col("size") == p[0], F.array(*(F.lit(n) for n in p[1]))).otherwise(rest), places.items(), F.lit(None))
    dealt = index.withColumn("at", F.explode(met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                if size not in turns:
                    turns[size] = rotation(size, seed)
                ids = np.frombuffer(row["ids"], "i8")
                code = (np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"]), np.frombuffer(row["fit"]))
                found = search_block(
                    ids, np.frombuffer(row["vectors"]).reshape(-1, size), code, np.frombuffer(row["query_ids"], "i8"),
                    np.frombuffer(row["query_vectors"]).reshape(-1, size), turns[size], k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    pairs = dealt.join(numbered, "at").repartition(F.col("at"), F.xxhash64("ids")).mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
