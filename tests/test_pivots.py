"""Exact neighbours by pivots against all pairs."""

import numpy as np
import pytest

from palisade.operators import pivots as P

QUERIES, CORPUS = "query_id long, embedding array<double>", "id long, embedding array<double>"


def brute(queries, corpus, k):
    wanted = set()
    for qid, q in queries:
        d = sorted((round(float(((np.array(v) - np.array(q)) ** 2).sum()), 6), i) for i, v in corpus)
        wanted |= {(qid, i, x, n) for n, (x, i) in enumerate(d[:k], 1)}
    return wanted


def measured_share(rows, vectors, asked, k, **options):
    corpus = [(i, v.tolist()) for i, v in enumerate(vectors)]
    queries = [(i, vectors[i].tolist()) for i in asked]
    found, measured = P.pivot_search(rows(QUERIES, queries), rows(CORPUS, corpus), k, **options)
    assert {(x.query_id, x.id, x.distance, x["rank"]) for x in found.collect()} == brute(queries, corpus, k)
    return sum(x.measured for x in measured.collect()) / (len(corpus) * len(queries))


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_equals_all_pairs(rows, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    vectors = np.round(centres[rng.integers(20, size=900)] + spread * rng.normal(size=(900, 12)), 3)
    vectors[100:140] = vectors[100]  # ties
    share = measured_share(rows, vectors, range(0, 900, 45), 7, block_rows=64, query_rows=8)
    assert share < 0.15 if spread < 1 else share <= 1  # what lies in clusters is left out, all else is measured


def test_small_and_broken_tables(rows):
    few = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [float("inf"), 0.0])]
    got = P.knn_pivots(rows(QUERIES, [(9, [0.0, 0.0]), (8, None)]), rows(CORPUS, few), 5)
    assert {(x.query_id, x.id, x.distance, x["rank"]) for x in got.collect()} == {(9, 1, 0.0, 1), (9, 2, 25.0, 2)}
    assert P.knn_pivots(rows(QUERIES, [(9, [0.0, 0.0])]), rows(CORPUS, []), 5).count() == 0
    assert P.knn_pivots(rows(QUERIES, []), rows(CORPUS, few), 5).count() == 0
