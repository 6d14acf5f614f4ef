"""Hard negatives against brute force over Python integers."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from palisade.llm import hard_negatives, queries
from pyspark.sql import functions as F


SCHEMA = "vec_id long, embedding array<double>, label long, score string, rank string, uid string"


def brute_force(rows):
    """Rows are (vec_id, vector, label); numbers of repeated ids keep their order of (id, label, vector) only where scores differ."""
    usable = [
        (i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (anchor, a, y) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(
            (-sum(p * q for p, q in zip(a, b, strict=True)), i is None, i or 0, z != y) for n, (i, b, z) in enumerate(usable) if n != k and len(a) == len(b)
        )
        for p, unnamed, i, other in [r for r in scored if not r[3]][:5]:
            near = [r for r in scored if r[3] and 80 * -p <= 100 * -r[0] <= 100 * -p][:5]
            out += [(anchor, None if unnamed else i, rank, None if r[1] else r[2], -p, -r[0]) for rank, r in enumerate(near, 1)]
    return Counter(out)


def mined(df, **options):
    found = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


@settings(max_examples=60, deadline=None)
@given(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40)), st.integers(0, 62), st.integers(0, 9))
def test_products_are_exact(shape, width, seed):
    rng = np.random.default_rng(seed)
    rows, inner, columns = shape
    a, b = (rng.integers(-(1 << width), 1 << width, s) for s in ((rows, inner), (inner, columns)))
    exact = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a]
    fits = [[((v + 2**63) % 2**64) - 2**63 for v in row] for row in exact]
    assert hard_negatives.multiply(a, b).tolist() == (fits if rows and columns else np.zeros((rows, columns)).tolist())


def test_merging_keeps_the_first_of_every_slot():
    rng = np.random.default_rng(1)
    n = 500
    parts = [
        hard_negatives.Heap(*(c.astype("i8") for c in (rng.integers(0, 9, n), rng.integers(-5, 5, n))), rng.random(n) < 0.1, rng.integers(0, 50, n), np.zeros(n, "i8"), np.arange(n) + k * n)
        for k in range(3)
    ]
    together = hard_negatives.merged(hard_negatives.merged(parts[0], parts[1], 4), parts[2], 4)
    rows = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts, strict=True)), strict=True), key=lambda r: (r[0], -r[1], *r[2:]))
    want = [r for k, r in enumerate(rows) if sum(q[0] == r[0] for q in rows[:k]) < 4]
    assert list(zip(*(c.tolist() for c in together), strict=True)) == want


def test_given_vectors(spark, sf, table):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table("embeddings").collect()]
    got = Counter(map(tuple, queries.op11_hard_negatives(spark, sf).collect()))
    assert got and got == brute_force(rows)


@pytest.mark.parametrize("options", [{}, {"pass_anchors": 2}])
def test_odd_rows(spark, options, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 2)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.integers(-3, 4, 3) / 4).tolist(), int(rng.integers(0, 3))) for k in range(0, 400, 4)]  # many ties
    rows += [(401, [1.0, math.nan, 0.0], 1), (402, [math.inf, 0.0, 1.0], 1), (500, [None, 1.0, 1.0], 1), (600, None, 1), (700, [1.0, 1.0, 1.0], None)]
    rows += [(800, [1.0, 1.0], 1), (801, [1.0, 0.5], 1), (802, [0.9, 1.0], 2), (900, [], 1), (901, [], 1), (902, [], 2)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (None, [0.9, 1.0, 1.0], 2), (200, *rows[50][1:]), (204, *rows[51][1:])]  # no id; repeated rows
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    got = mined(df, **options)
    assert got == brute_force(rows)
    assert any(r[0] == 900 and r[1:4] == (901, 1, 902) for r in got)


def test_label_of_most_rows_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) + 1).round(3).tolist(), 1 if k % 3 else k) for k in range(700)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert mined(df.repartition(3)) == brute_force(rows)
    assert mined(df.limit(0)) == Counter()
    assert mined(df.filter("vec_id % 100 <> 0")) == Counter()
    wide = [(100, [1e300, 1.0], 1), (101, [1.0, 1.0], 1), (200, [1e6, 1e6], 1), (201, [1e6, 1e6], 1), (202, [1e6, 9e5], 2)]
    got = mined(spark.createDataFrame([(*r, "x", "y", "z") for r in wide], SCHEMA))
    assert got == brute_force(wide[1:]) and got[(200, 201, 1, 202, 2 * 256**2 * 10**12, 256**2 * (10**12 + 9 * 10**11))] == 1
