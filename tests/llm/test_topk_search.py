"""The bit-sliced top-k search against sorted integer products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import topk_search

ROWS = "vec_id long, embedding array<float>, score long, row long"


def brute(rows, k=5, scale=256):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j, m) for m, (j, x) in enumerate(whole) if m != n and len(x) == len(q))
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], ROWS).repartition(parts)
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in rng.normal(0, spread, (n, dim)).astype(np.float32)]


def test_all_queries_against_brute_force(spark):
    rows = list(enumerate(vectors(700, 16, 3)))
    rows += [(1000 + k, rows[100][1]) for k in range(300)]  # a third of all rows are equal: ties by vec_id
    assert run(spark, rows) == brute(rows)


def test_many_blocks_and_wide_components(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "HELD", 3)
    monkeypatch.setattr(topk_search, "LEAST_QUERIES", 2)
    rows = [(5 * i, [x * s for x in v]) for i, (v, s) in enumerate(zip(vectors(500, 9, 5), [1, 30, 4000, 1, 1] * 100, strict=True))]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_slices_leave_no_row_out(bits, monkeypatch):
    monkeypatch.setattr(topk_search, "BITS", bits)
    rng = np.random.default_rng(bits)
    x = rng.integers(-300, 300, (1000, 7))
    x[::3] = x[0]
    low, width, slices = topk_search.Slices.build(x)
    index = topk_search.Slices(x, low, width, slices)
    for q in rng.integers(-260, 260, (40, 7)):
        s = x @ q
        s[13] = -(1 << 40)
        at = set(index.top(q, 5, 13).tolist())
        assert 13 not in at and set(np.nonzero(s >= np.sort(s)[-5])[0].tolist()) <= at
        if bits == 12:  # with all bits there are only ties at the boundary
            assert min(s[list(at)]) == np.sort(s)[-5]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, None), (2, [0.1, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (50, [0.0, 0.0]), (100, []), (7, []), (150, [1.0, 2.0, 3.0]), (-50, [-0.001, 0.3]), (9, [-0.5, 0.7]), (None, [0.5, 0.5]), (50, None)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert (100, 1, 7, 0) in want and not [r for r in want if r[0] == 150]  # alone of its length
    assert [r for r in want if r[0] == 0 and r[2] == 0] == [(0, 1, 0, 20480)] * 2  # each repeated row asks, and is found


def test_empty_table(spark):
    assert run(spark, []) == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="62 bits"):
        run(spark, [(0, [1e20, 0.0]), (1, [0.0, 1.0])])
