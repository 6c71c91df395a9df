"""Centroid clustering against plain loops over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from mailgraph.llm import centroids


def brute(rows, dims, k, rounds):
    kept = [
        (i, [math.floor(64 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, group in groups.items():
            middle[n] = [sum(column) // len(group) for column in zip(*group)]
    found = [(i, *nearest(v)) for i, v in kept]
    most = 2**63 - 1
    within = {n: min(most, sum(min(d, most) for _, d, m in found if m == n)) for _, _, n in found}
    whole = min(most, sum(min(d, most) for _, d, _ in found))
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, n, min(d, most), within[n], whole, name[n]) for i, d, n in found), key=repr)


def clusters(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'c' AS cluster", "1 AS _id")
    return sorted((tuple(r) for r in centroids.cluster(df.repartition(5), **options).collect()), key=repr)


def grouped(n, dims, seed, spread=0.1):
    rng = random.Random(seed)
    tops = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(tops)]) for i in range(n)]


@pytest.mark.parametrize("dims, k, rounds", [(64, 16, 3), (5, 4, 6), (3, 16, 1)])
def test_equals_all_distances(spark, dims, k, rounds):
    rows = grouped(250, dims, dims)
    rows += [(7, rows[7][1])] * 3 + [(300 + n, rows[9][1]) for n in range(30)]
    rows += [(8, [0.5] * dims), (None, [0.25] * dims), (400, None), (401, [0.1] * (dims - 1)), (402, []),
             (403, [math.nan] * dims), (404, [math.inf] + [0.0] * (dims - 1)), (405, [None] * dims)]
    assert clusters(spark, rows, dims=dims, k=k, rounds=rounds) == brute(rows, dims, k, rounds)


def test_equal_vectors_and_few_rows(spark):
    rows = [(n, [0.5, -0.25]) for n in range(40)]
    assert clusters(spark, rows, dims=2) == brute(rows, 2, 16, 3)
    rows = [(1, [0.5, -0.25]), (2, [1.0, 1.0])]
    assert clusters(spark, rows, "float", dims=2) == brute(rows, 2, 16, 3)
    assert clusters(spark, [], dims=2) == []


@pytest.mark.parametrize("size", [1e6, 1e9])
def test_large_components(spark, size):
    rng = random.Random(3)
    rows = [(n, [rng.uniform(-size, size) for _ in range(6)]) for n in range(60)]
    assert clusters(spark, rows, dims=6, k=5) == brute(rows, 6, 5, 3)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    tops = rng.integers(-90, 90, (16, 64))
    rows = tops[rng.integers(0, 16, 3000)] + rng.integers(-4, 5, (3000, 64))
    pivots = centroids.choose_pivots(rows[:256])
    table, centroid_table = centroids.to_pivots(rows, pivots), centroids.to_pivots(tops, pivots)
    true = ((rows[:, None, :] - tops[None]) ** 2).sum(axis=2)
    assert (centroids.lower_bounds(table, centroid_table) ** 2 <= true).all()
    cluster, best, measured = centroids.nearest(rows, table, tops, centroid_table)
    assert (cluster == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert measured < true.size / 4
