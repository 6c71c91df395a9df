"""Exact top-k search by inner product through vector-approximation files.

Vectors are dealt into blocks. The approximation file of a block holds one byte a component: each
dimension is cut into at most CELLS equal steps and a vector keeps the number of its cell. Blocks
of queries go to the approximation files, and a scan of the cells gives a lower and an upper bound
of every product. What cannot be among the best k of its block, then of all blocks, is out. Of the
rest the exact vectors are read by falling lower bound: first as many as wanted; then only those
whose upper bound reaches the k-th best product found.

Exact vectors stay out of the scan; only the queries (one row in ``every``) and the cells travel
to it, and a block of queries is thousands of them, so that cells are copied seldom.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.session import settle

CELLS, SCALE = 256, 64
# Rows of a block of vectors or queries, at most; queries whose bounds are held at a time.
BLOCK_ROWS, QUERY_ROWS, SCAN = 65536, 16384, 64
# Small tables are cut into blocks of at least so many rows, one for each core.
LEAST_ROWS = 1024
_LEAST = np.iinfo(np.int64).min


def whole_numbers(df: DataFrame, vector: str, scale: float = SCALE) -> DataFrame:
    """Append ``numbers``: floor(scale * x) of each component; rows that are null or hold a null
    or non-finite component go."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(
        doubles,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    rows = df.where(F.col(vector).isNotNull() & fine)
    return rows.withColumn("numbers", F.transform(doubles, lambda x: F.floor(x * float(scale))))


class Approximation:
    """Cells of a block of vectors of whole numbers."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.low, self.step, self.cells = low, step, cells

    @classmethod
    def of(cls, exact: np.ndarray, cells: int = CELLS) -> Approximation:
        low, high = exact.min(axis=0), exact.max(axis=0)
        # In unbounded numbers: a dimension may span more than 63 bits.
        spans = [int(b) - int(a) + 1 for a, b in zip(low, high)]
        step = np.array([max(1, -(-span // cells)) for span in spans], np.int64)
        shifted = exact.astype(np.uint64) - low.astype(np.uint64)
        return cls(low, step, (shifted // step.astype(np.uint64)).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products with the lower corners of all cells, and by how much at most the product of a
        query with a vector is less or more. All are exact, in the narrowest kind that holds them."""
        pull = queries * self.step
        reach = float(np.abs(pull).sum(axis=1).max(initial=0)) * (CELLS - 1)
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
        products = pull.astype(kind) @ self.cells.astype(kind).T
        base = queries @ self.low
        width = self.step - 1
        fall, rise = np.minimum(queries, 0) @ width, np.maximum(queries, 0) @ width
        return products.astype(np.int64) + base[:, None], fall, rise


def possible(
    approximation: Approximation, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray,
    k: int,
):
    """Yields (query, places in the block, lower, upper bounds) of all that can be among its best k.

    With (L, i) the k-th of the lower bounds, ties by smaller id, k vectors have a product of more
    than L or of L with an id up to i; so what has a smaller upper bound, or L and a larger id, is out.
    """
    for start in range(0, len(queries), SCAN):
        corners, fall, rise = approximation.bounds(queries[start : start + SCAN])
        for q in range(len(corners)):
            at = np.flatnonzero(rows != own[start + q])
            lower, upper = corners[q, at] + fall[q], corners[q, at] + rise[q]
            if len(at) > k:
                sure = np.partition(lower, len(lower) - k)[len(lower) - k]
                equal = np.sort(ids[at[lower == sure]])
                last = equal[k - int((lower > sure).sum()) - 1]
                fits = (upper > sure) | ((upper == sure) & (ids[at] <= last))
                at, lower, upper = at[fits], lower[fits], upper[fits]
            yield start + q, at, lower, upper


def _narrowest(most: int) -> str:
    return next((kind for kind in ("<i1", "<i2", "<i4") if most <= np.iinfo(kind).max), "<i8")


def _vectors(data: list[bytes], kind: str, dims: int) -> np.ndarray:
    found = np.frombuffer(b"".join(data), kind).reshape(len(data), dims)
    return found.astype(np.int64)


def _blocks(exact: DataFrame, blocks: int, salt: int) -> DataFrame:
    number = F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(blocks)).cast("int").alias("block")
    return exact.select("_row", "_id", "dims", "raw", number)


def _approximations(exact: DataFrame, blocks: int, kind: str) -> DataFrame:
    """One row for each block of vectors of equal length: the approximation file."""

    def pack(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        found = Approximation.of(_vectors(table["raw"].to_pylist(), kind, dims), CELLS)
        parts = {
            "rows": table["_row"].to_numpy(), "ids": table["_id"].to_numpy(), "low": found.low,
            "step": found.step, "cells": found.cells,
        }
        packed = {name: pa.array([part.tobytes()], pa.binary()) for name, part in parts.items()}
        return pa.table({"dims": table["dims"][:1], "block": table["block"][:1], **packed})

    return _blocks(exact, blocks, 1).groupBy("dims", "block").applyInArrow(
        pack, "dims int, block int, rows binary, ids binary, low binary, step binary, cells binary"
    )


def _asked(exact: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of queries."""

    def pack(table: pa.Table) -> pa.Table:
        parts = {"own_rows": table["_row"].to_numpy().tobytes(), "own_ids": table["_id"].to_numpy().tobytes(),
                 "asked": b"".join(table["raw"].to_pylist())}
        packed = {name: pa.array([part], pa.binary()) for name, part in parts.items()}
        return pa.table({"dims": table["dims"][:1], "query_block": table["block"][:1], **packed})

    return _blocks(exact, blocks, 2).groupBy("dims", "block").applyInArrow(
        pack, "dims int, query_block int, own_rows binary, own_ids binary, asked binary"
    )


def _scanned(approximations: DataFrame, asked: DataFrame, blocks: int, query_blocks: int, kind: str, k: int) -> DataFrame:
    """(_query, query_id, _row, vec_id, lower, upper) of all that each block leaves possible."""

    def scan(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                rows, ids, own_rows, own_ids, low, step = (
                    np.frombuffer(pair[c], np.int64) for c in ("rows", "ids", "own_rows", "own_ids", "low", "step")
                )
                cells = np.frombuffer(pair["cells"], np.uint8).reshape(len(rows), pair["dims"])
                queries = np.frombuffer(pair["asked"], kind).reshape(len(own_rows), pair["dims"]).astype(np.int64)
                found = possible(Approximation(low, step, cells), queries, own_rows, rows, ids, k)
                out = [[np.array([], np.int64)] for _ in range(6)]
                for q, at, lower, upper in found:
                    columns = (np.full(len(at), own_rows[q]), np.full(len(at), own_ids[q]), rows[at], ids[at], lower, upper)
                    for values, column in zip(out, columns):
                        values.append(column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values)) for values in out],
                    ["_query", "query_id", "_row", "vec_id", "lower", "upper"],
                )

    # A pair of blocks is one row: the smaller side, the queries, is sent to every block.
    spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    files = approximations.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    pairs = files.join(spread, ["dims", "block", "query_block"])
    return pairs.mapInArrow(
        scan, "_query long, query_id long, _row long, vec_id long, lower long, upper long"
    )


def _read(candidates: DataFrame, exact: DataFrame, kind: str) -> DataFrame:
    """Candidates with their ``score``, from the exact vectors."""

    def multiply(batches):
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            score = np.zeros(len(sizes), np.int64)
            ours, theirs = (batch.column(c).to_pylist() for c in ("raw", "asked"))
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                one, other = (_vectors([data[x] for x in at], kind, dims) for data in (ours, theirs))
                score[at] = np.einsum("ij,ij->i", one, other)
            names = ["_query", "query_id", "vec_id"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(score)], [*names, "score"]
            )

    own = exact.select(F.col("_row").alias("_query"), F.col("raw").alias("asked"))
    both = candidates.select("_query", "query_id", "_row", "vec_id")
    both = both.join(exact.select("_row", "dims", "raw"), "_row").join(own, "_query")
    return both.select("_query", "query_id", "vec_id", "dims", "raw", "asked").mapInArrow(
        multiply, "_query long, query_id long, vec_id long, score long"
    )


def top_k(
    df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each query with other rows.

    Queries are the rows whose key is divisible by ``every``. Products are of whole numbers,
    floor(64 * x), exact within 64 bits; ties go to the smaller key. Rows whose key or vector is
    null, or whose vector holds a null or non-finite component, take no part; vectors meet only
    those of equal length. Equal rows are rows of their own. A query with fewer than k partners
    has them all; an empty table gives an empty one. Other columns are not read.
    """
    own = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector"))
    rows = whole_numbers(own.where("_id IS NOT NULL"), "_vector").select("_id", "numbers")
    largest = F.greatest(F.array_max("numbers"), -1 - F.array_min("numbers"))
    about = rows.agg(F.count("*"), F.count(F.when(F.col("_id") % every == 0, 1)), F.max(largest)).first()
    kind = _narrowest(about[2] or 0)

    def narrowed(batches):
        for batch in batches:
            lists = batch.column("numbers")
            numbers = lists.flatten().to_numpy().astype(kind)
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            raw = [numbers[b - a : b].tobytes() for a, b in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], ["_id", "dims", "raw"]
            )

    exact = rows.mapInArrow(narrowed, "_id long, dims int, raw binary")
    exact = settle(exact.withColumn("_row", F.monotonically_increasing_id()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-about[0] // BLOCK_ROWS), min(cores, about[0] // LEAST_ROWS))
    query_blocks = max(1, -(-about[1] // QUERY_ROWS))
    files = _approximations(exact, blocks, kind)
    asked = _asked(exact.where(F.col("_id") % every == 0), query_blocks)
    found = settle(_scanned(files, asked, blocks, query_blocks, kind, k))

    # The same cut over all blocks, then the exact vectors by falling lower bound.
    order = Window.partitionBy("_query").orderBy(F.desc("lower"), "vec_id")
    placed = found.withColumn("place", F.row_number().over(order))
    first = settle(placed.where(F.col("place") <= k).select("_query", "query_id", "_row", "vec_id", "place"))
    scored = settle(_read(first, exact, kind))
    sure = settle(
        scored.groupBy("_query").agg(F.min("score").alias("sure"), F.count("*").alias("n")).where(F.col("n") == k)
    )
    later = found.join(sure, "_query").where("upper >= sure").join(first.select("_query", "_row"), ["_query", "_row"], "left_anti")
    both = scored.unionByName(_read(later, exact, kind))
    best = Window.partitionBy("_query", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
