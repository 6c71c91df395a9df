"""Importance resampling towards a target text collection.

Features are runs of words, hashed into buckets. A bucket's gain, the logarithm of how much more
often the target holds it than the documents do, is an entry of one array; a document's weight is
the mean of its features' gains. Weight and a Gumbel draw from a digest of the key make the
score, and the highest scores are drawn without replacement.

The cutoff score is found by selection, not by a sort of all documents: chunks of rows give their
medians, weighted by their sizes, tasks give the weighted median of these, and the weighted median
of all tasks is the pivot. It has at least an eighth of the remaining keys on either side, so each
round discards that much for sure. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.llm.common import append_columns, texts_of
from mailgraph.operators.numbering import dense_ids
from mailgraph.session import settle

BUCKETS, RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
# Remaining keys that are few enough to be sorted on the driver, and how much smaller than the
# stored rows the remaining ones are before they are stored anew.
LAST_KEYS, SHRINK = 4096, 8

# A to Z become small; digits, small letters and bytes from 128 stay; all else parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
# Total order of the keys: score falls; null ids come last; the row tells equal rows apart.
ORDER = ["_down", "_unnamed", "_name", "n_features", "_row"]


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features(text: bytes, longest: int = RUN) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``longest`` words."""
    found = words(text)
    runs = list(found)
    for size in range(2, longest + 1):
        runs += [b" ".join(found[n : n + size]) for n in range(len(found) - size + 1)]
    return len(found), runs


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 2**16 else "<u4"


def with_buckets(df: DataFrame, text: str, buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """Append ``n_words`` and ``buckets``, the bucket of every feature, little-endian."""

    def hashed(column):
        counts, cells = [], []
        for value in texts_of(column):
            n, runs = features(value, longest)
            hashes = np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
            counts.append(n)
            cells.append((hashes % buckets).astype(_kind(buckets)).tobytes())
        return [counts, cells]

    return append_columns(df, [text], "n_words long, buckets binary", hashed)


def bucket_counts(cells: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: ``buckets`` numbers, whatever the number of rows."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("buckets"):
                held = np.frombuffer(value.as_buffer() or b"", _kind(buckets))
                sums += np.bincount(held, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = cells.select("buckets").mapInArrow(count, "bucket long, n long")
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of smoothed share in the target / smoothed share in the documents)."""
    size, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))))
            for s, t in zip(own.tolist(), target.tolist())
        ],
        np.int64,
    )


def with_weights(cells: DataFrame, gain: np.ndarray) -> DataFrame:
    """Append ``n_features`` and ``weight``: the floored mean gain, 0 without features."""

    def weigh(column):
        counts, weights = [], []
        for value in column:
            held = np.frombuffer(value.as_buffer() or b"", _kind(len(gain)))
            counts.append(len(held))
            weights.append(int(gain[held].sum()) // len(held) if len(held) else 0)
        return [counts, weights]

    return append_columns(cells, ["buckets"], "n_features long, weight long", weigh).drop("buckets")


def draw(name: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a standard Gumbel number made of a digest of seed and name."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _compare(keys: np.ndarray, one) -> np.ndarray:
    """-1, 0 or 1 where a key (a row) comes before, is or comes after ``one``."""
    out = np.zeros(len(keys), np.int8)
    for n in range(keys.shape[1] - 1, -1, -1):
        column = keys[:, n]
        out = np.where(column < one[n], -1, np.where(column > one[n], 1, out))
    return out


def _median(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple:
    """The key at half of the weight."""
    order = np.lexsort(keys.T[::-1])
    weights = np.ones(len(keys), np.int64) if weights is None else weights
    half = np.searchsorted(np.cumsum(weights[order]), -(-int(weights.sum()) // 2))
    return tuple(int(x) for x in keys[order[half]])


def _before(columns: list[str], one: tuple) -> Column:
    """Whether a row's key comes before ``one``."""
    first, rest = columns[0], columns[1:]
    less = F.col(first) < one[0]
    return less | ((F.col(first) == one[0]) & _before(rest, one[1:])) if rest else less


def cutoff(keys: DataFrame, k: int) -> tuple | None:
    """The ``k``-th smallest key, k from 1; the columns are whole numbers and tell all rows apart.

    None if there are fewer than k. Each round is one narrow scan: it counts the keys before the
    pivot and brings the medians of both sides, so that the next pivot is known at once. The
    remaining rows are stored anew whenever they have shrunk, so all rounds together read a fixed
    multiple of the table. One row a task and side reaches the driver.
    """
    columns = keys.columns
    width = len(columns)
    stored = left = keys.count()
    if not 1 <= k <= left:
        return None
    schema = ", ".join(f"`{c}` long" for c in columns) + ", _side int, _rows long"

    def split(pivot):
        def run(batches):
            medians, sizes = ([], []), ([], [])
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
                sides = (np.zeros(len(rows)) if pivot is None else _compare(rows, pivot))
                for side, mine in enumerate((rows[sides <= 0 if pivot is None else sides < 0], rows[sides > 0])):
                    if len(mine):
                        medians[side].append(_median(mine))
                        sizes[side].append(len(mine))
            for side in (0, 1):
                if sizes[side]:
                    weights = np.array(sizes[side], np.int64)
                    one = _median(np.array(medians[side], np.int64), weights)
                    cells = [pa.array([x], pa.int64()) for x in one]
                    cells += [pa.array([side], pa.int32()), pa.array([int(weights.sum())], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cells, [*columns, "_side", "_rows"])

        return run

    rest, pivot, side = keys, None, 0
    while left > LAST_KEYS:
        found = rest.mapInArrow(split(pivot), schema).collect()
        count = sum(r["_rows"] for r in found if r["_side"] == 0)
        if pivot is not None:
            if k == count + 1:
                return pivot
            side = int(k > count)
            rest = rest.where(_before(columns, pivot) if not side else ~_before(columns, pivot) & ~_same(columns, pivot))
            k, left = (k - count - 1, left - count - 1) if side else (k, count)
        mine = [r for r in found if r["_side"] == side]
        pivot = _median(np.array([r[:width] for r in mine], np.int64), np.array([r["_rows"] for r in mine]))
        if left * SHRINK < stored:
            rest, stored = settle(rest), left
    return tuple(sorted(tuple(r) for r in rest.collect())[k - 1])


def _same(columns: list[str], one: tuple) -> Column:
    out = F.lit(True)
    for c, x in zip(columns, one):
        out = out & (F.col(c) == x)
    return out


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
    target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
    longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; ``rank`` is null for rows not drawn.

    Of the N rows with ``min_words`` words, floor(percent * N / 100) are drawn, the highest scores
    first, ties to the smaller key, then to fewer features. Null and empty texts have no feature
    and weight 0; a null key is drawn like an empty one and comes after all others. Rows that
    share a key are rows of their own; equal rows get neighbouring ranks. An empty table gives an
    empty one, an empty target gains from its smoothing alone. Other columns are not read.
    """
    rows = df.select(F.col(key).cast("long").alias("_name"), F.col(text).alias("_text"))
    cells = settle(with_buckets(rows, "_text", buckets, longest).select("_name", "n_words", "buckets"))
    wanted = with_buckets(target.select(F.col(target_text).alias("_text")), "_text", buckets, longest)
    gain = gains(bucket_counts(cells, buckets), bucket_counts(wanted, buckets))
    scored = with_weights(cells, gain).withColumn("score", F.col("weight") + draw(F.col("_name"), seed))
    scored = scored.withColumns(
        {"_row": F.monotonically_increasing_id(), "_down": -F.col("score"),
         "_unnamed": F.col("_name").isNull().cast("long")}
    )
    scored = settle(scored)
    able = F.col("n_words") >= min_words
    number = percent * scored.where(able).count() // 100
    filled = scored.withColumn("_name", F.coalesce("_name", F.lit(0).cast("long")))
    last = cutoff(filled.where(able).select(*ORDER), number)
    shown = F.when(F.col("_unnamed") == 0, F.col("_name")).alias(key)
    if last is None:
        return filled.select(shown, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    won = able & (_before(ORDER, last) | _same(ORDER, last))
    ranked = dense_ids(filled.where(won), ORDER, "rank", start=1)
    others = filled.where(~won).withColumn("rank", F.lit(None).cast("long"))
    out = [shown, "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*out).unionByName(others.select(*out))
