"""Centroid clustering of vectors, with a LAESA pivot table.

A few fixed pivots are chosen, and every vector's distances to them are stored once, beside the
vector. In each round the centroids' distances to the pivots are computed, and by the triangle
inequality the difference of the two, at any pivot, bounds the distance of vector and centroid
from below. The centroid with the least bound is measured first; after that only centroids whose
bound does not exceed the best distance so far are measured, in whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm.vafile import whole_numbers
from mailgraph.session import settle

DIMS, CENTROIDS, ROUNDS, PIVOTS, SEED = 64, 16, 3, 16, 1
# Rows, first by their hash, among which the pivots are chosen: a bounded sample. Pivots only
# steer how many distances are measured, never a result.
PIVOT_SAMPLE = 256
# Components below this differ so little that 64-bit sums of squares are exact for 64 of them.
_NARROW = 2**27
_MOST = 2**63 - 1
# Bounds are doubles; so much, relatively, is left for rounding.
_SLACK = 1e-9


def squared(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact squared distances; object arrays hold numbers of any size."""
    apart = rows - one
    return (apart * apart).sum(axis=1) if rows.dtype == object else np.einsum("ij,ij->i", apart, apart)


def exact(rows: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are, if 64 bits hold all sums of squares, else with unbounded numbers."""
    limit = _NARROW // max(1, math.isqrt(max(1, rows.shape[1] // 64)))
    wide = any(a.size and max(-int(a.min()), int(a.max())) >= limit for a in (rows, *others))
    return [a.astype(object) if wide else a.astype(np.int64) for a in (rows, *others)]


def roots(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows that lie far apart: each next one is the farthest from those chosen before."""
    if not len(sample):
        return sample
    (sample,) = exact(sample)
    chosen = [0]
    nearest = squared(sample, sample[0])
    while len(chosen) < min(count, len(sample)):
        one = int(np.argmax(nearest))
        chosen.append(one)
        nearest = np.minimum(nearest, squared(sample, sample[one]))
    return sample[chosen]


def to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows to the pivots, one column a pivot."""
    rows, pivots = exact(rows, pivots)
    return np.stack([roots(squared(rows, one)) for one in pivots], axis=1)


def lower_bounds(table: np.ndarray, centroid_table: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of rows and centroids, from their distances to pivots."""
    low = np.zeros((len(table), len(centroid_table)))
    for at in range(table.shape[1]):
        ours, theirs = table[:, at, None], centroid_table[None, :, at]
        np.maximum(low, np.abs(ours - theirs) - _SLACK * (ours + theirs), out=low)
    return low


def nearest(
    rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, centroid_table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, distances measured); ties: the smaller."""
    rows, centroids = exact(rows, centroids)
    low = lower_bounds(table, centroid_table)
    low *= low
    cluster = low.argmin(axis=1)
    best = squared(rows, centroids[cluster])
    measured = len(rows)
    untried = np.ones(low.shape, bool)
    untried[np.arange(len(rows)), cluster] = False
    for c, one in enumerate(centroids):
        reach = best.astype(np.float64) * (1 + _SLACK)
        at = np.flatnonzero(untried[:, c] & (low[:, c] <= reach))
        if len(at):
            found = squared(rows[at], one)
            better = (found < best[at]) | ((found == best[at]) & (c < cluster[at]))
            best[at[better]], cluster[at[better]] = found[better], c
            measured += len(at)
    return cluster, best, measured


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def kept_vectors(df: DataFrame, key: str, vector: str, dims: int = DIMS) -> DataFrame:
    """(_id, numbers, _draw) of the rows whose vector has ``dims`` finite components."""
    own = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector"))
    rows = whole_numbers(own.where(F.size("_vector") == dims), "_vector").select("_id", "numbers")
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    return rows.withColumn("_draw", F.sha2(text, 256))


def assigned(rows: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """(_id, cluster, distance): the nearest centroid of every row of the stored table."""
    centroid_table = to_pivots(centroids, pivots)
    dims = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            numbers, table = _matrix(batch.column(1), dims), _matrix(batch.column(2), len(pivots))
            cluster, best, _ = nearest(numbers, table, centroids, centroid_table)
            best = [min(x, _MOST) for x in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())],
                ["_id", "cluster", "distance"],
            )

    kept = rows.select("_id", "numbers", "to_pivots")
    return kept.mapInArrow(assign, "_id long, cluster int, distance long")


def moved(rows: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of the rows assigned.

    A task gives back sums, one row a centroid and component, so neither rows nor groups travel.
    """
    centroid_table = to_pivots(centroids, pivots)
    k, dims = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dims), object), [0] * k
        for batch in batches:
            numbers, table = _matrix(batch.column(0), dims), _matrix(batch.column(1), len(pivots))
            cluster, _, _ = nearest(numbers, table, centroids, centroid_table)
            (numbers,) = exact(numbers)
            for c in np.unique(cluster).tolist():
                mine = numbers[cluster == c]
                total[c] += mine.sum(axis=0).astype(object)
                count[c] += len(mine)
        used = [c for c in range(k) if count[c]]
        cells = [(c, d, Decimal(int(total[c, d])), count[c]) for c in used for d in range(dims)]
        names, kinds = ["c", "d", "total", "n"], [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = list(zip(*cells)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    parts = rows.select("numbers", "to_pivots").mapInArrow(sums, "c int, d int, total decimal(38,0), n long")
    out = centroids.copy()
    # k * dims rows reach the driver, whatever the number of vectors.
    for c, d, total, n in parts.groupBy("c", "d").agg(F.sum("total"), F.sum("n")).collect():
        out[c, d] = int(total) // n
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS,
    k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Kept are vectors of exactly ``dims`` components, none null or non-finite, as whole numbers
    floor(64 * x). The first centroids are the ``k`` vectors with the least digest of the key, or
    all if there are fewer; of equal digests (repeated keys) the smaller vector, component by
    component. A null key has the digest of an empty one. Equal rows count as often as they come.
    Arithmetic is exact at any size; distances and inertia of over 63 bits are given as 2^63 - 1.
    An empty table gives an empty one. Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    vectors = kept_vectors(df, key, vector, dims)
    # Both lists have fixed bounds.
    sample = vectors.orderBy("_draw", "numbers").limit(max(k, PIVOT_SAMPLE)).select("numbers").collect()
    numbers = np.array([row["numbers"] for row in sample], np.int64).reshape(len(sample), dims)
    centroids, chosen = numbers[:k].astype(object), choose_pivots(numbers[:PIVOT_SAMPLE], pivots)
    if not len(sample):
        return spark.createDataFrame(
            [], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long,"
            " centroid_sha256 string",
        )

    def measure(batches):
        for batch in batches:
            found = to_pivots(_matrix(batch.column("numbers"), dims), chosen)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(chosen))
            lists = lists.cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "to_pivots"])

    stored = vectors.select("_id", "numbers").mapInArrow(
        measure, "_id long, numbers array<long>, to_pivots array<double>"
    )
    stored = settle(stored)
    for _ in range(rounds):
        centroids = moved(stored, chosen, centroids)
    found = settle(assigned(stored, chosen, centroids))
    spent = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("spent"))
    inertia = {row["cluster"]: int(row["spent"]) for row in spent.collect()}
    whole = min(sum(inertia.values()), _MOST)
    # One row for each of the k centroids.
    about = spark.createDataFrame(
        [(c, min(one, _MOST), whole, digest(centroids[c])) for c, one in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(about), "cluster").select(
        F.col("_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
