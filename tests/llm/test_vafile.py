"""Top k against all products."""

import math
import random

import numpy as np
import pytest

from mailgraph.llm import vafile


def brute(rows, every=20, k=20):
    fine = [
        (i, [math.floor(64 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v) in enumerate(fine):
        if i % every == 0:
            found = [
                (-sum(x * y for x, y in zip(v, w)), j)
                for b, (j, w) in enumerate(fine) if a != b and len(v) == len(w)
            ]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def made(n, dims, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    return rows


@pytest.mark.parametrize("block, cells", [(16, 256), (16, 5), (65536, 256), (65536, 3)])
def test_equals_all_products(spark, monkeypatch, block, cells):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", block)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 5)
    monkeypatch.setattr(vafile, "CELLS", cells)
    rows = made(150, 12)
    rows += [(500, None), (520, [math.nan] * 12), (540, [math.inf] + [0.0] * 11), (None, [0.1] * 12),
             (560, [None] + [0.0] * 11), (580, [0.5, 0.5]), (581, [0.25, -0.5]), (600, []), (601, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "1 AS score", "2 AS rank", "'x' AS _row", "3 AS block")
    out = [tuple(r) for r in vafile.top_k(df).collect()]
    assert sorted(out) == brute(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert vafile.top_k(df).count() == 0
    assert vafile.top_k(df.limit(0)).count() == 0


def test_repeated_rows_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(20, [1.0])] * 3, "vec_id long, embedding array<float>")
    assert sorted(r["rank"] for r in vafile.top_k(df).collect()) == [1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("cells, size", [(7, 90), (256, 90), (256, 2**20), (256, 2**40)])
def test_bounds_hold_every_product(cells, size):
    rng = np.random.default_rng(1)
    exact = rng.integers(-size, size, (200, 8))
    file = vafile.Approximation.of(exact, cells)
    low = file.low + file.cells.astype(np.int64) * file.step
    assert (low <= exact).all() and (exact < low + file.step).all()
    assert file.cells.max() < cells
    queries = rng.integers(-90, 90, (30, 8))
    corners, fall, rise = file.bounds(queries)
    true = queries @ exact.T
    assert (corners + fall[:, None] <= true).all() and (true <= corners + rise[:, None]).all()


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 21, 60, 400])
@pytest.mark.parametrize("size", [3, 40, 2**29])
def test_the_best_stay_possible(n, size):
    """None of a query's best k is cut, whatever the size of components, ties and small blocks."""
    rng = np.random.default_rng(n)
    exact = rng.integers(-size, size, (n, 6))
    rows = np.arange(n)
    ids = rng.permutation(n)
    left = 0
    for q, at, lower, upper in vafile.possible(vafile.Approximation.of(exact), exact, rows, rows, ids, 20):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(exact[q], exact[j])), ids[j], j) for j in range(n) if j != q)
        assert {j for _, _, j in want[:20]} <= set(at.tolist())
        assert all(a <= sum(int(x) * int(y) for x, y in zip(exact[q], exact[j])) <= b
                   for j, a, b in zip(at.tolist(), lower.tolist(), upper.tolist()))
        left += len(at)
    if size <= 40:
        # One byte a component tells such numbers apart, so nothing else is left to be read.
        assert left == n * min(20, n - 1)


def test_widest_numbers():
    exact = np.array([[-(2**63), 5], [2**63 - 1, 5], [0, 5]])
    file = vafile.Approximation.of(exact)
    assert [int(a) + int(c) * int(s) <= int(x) for a, c, s, x in zip(file.low[[0] * 3], file.cells[:, 0], file.step[[0] * 3], exact[:, 0])] == [True] * 3
