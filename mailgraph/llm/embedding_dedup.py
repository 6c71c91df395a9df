"""Near-duplicates among vectors: random-hyperplane signs in several tables, exact cosines.

Equal vectors are one class. In each table a class has a bucket, the signs of its products with
random hyperplanes; two vectors at an angle a agree on a sign with a chance of 1 - a / pi. The
number of signs grows with the logarithm of the number of classes, so that buckets keep their
size, and the number of tables follows from the share of pairs at the threshold that must meet.
Inside a bucket every pair is verified by its cosine in double precision. A pair that meets in
several tables counts in the first one, so links are counted where they are found and never
listed: a bucket gives back the number of links of each member, and a forest that joins what its
links join. Forests of all buckets become components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.llm.simhash import components
from mailgraph.session import settle

THRESHOLD, RECALL, SEED = 0.9, 0.99, 13
# Members of a bucket on average, if signs were independent, and of one comparison at most. Larger
# buckets take more products inside a task, and fewer tables, that is copies of every vector.
BUCKET_ROWS, PART_ROWS = 512, 2048
LEAST_SIGNS, MOST_SIGNS = 4, 30


def layout(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a bucket, tables): a pair right at the threshold meets with chance ``recall``."""
    wanted = math.ceil(math.log2(max(1, classes) / BUCKET_ROWS))
    signs = min(MOST_SIGNS, max(LEAST_SIGNS, wanted))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def planes(dims: int, signs: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, tables * signs))


def buckets(vectors: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """Bucket numbers, one column a table."""
    above = vectors @ planes(vectors.shape[1], signs, tables) > 0
    return (above.reshape(len(vectors), tables, signs) @ (1 << np.arange(signs))).astype(np.int32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, each by a power of two that brings its largest component near 1."""
    vectors = vectors.astype(np.float64)
    _, exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponents[:, None])


def linked(one: np.ndarray, other: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs have a cosine of the threshold or more."""
    lengths = np.sqrt(np.einsum("ij,ij->i", one, one)), np.sqrt(np.einsum("ij,ij->i", other, other))
    return one @ other.T / (lengths[0][:, None] * lengths[1][None, :]) >= threshold


def forest(links: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """(first, member) for the members of each connected part of a symmetric matrix of links."""
    out = []
    waiting = links.any(axis=1)
    while waiting.any():
        first = int(np.argmax(waiting))
        front = np.array([first])
        waiting[first] = False
        while len(front):
            reached = np.flatnonzero(links[front].any(axis=0) & waiting)
            waiting[reached] = False
            out += [(int(names[first]), int(names[x])) for x in reached]
            front = reached
    return out


def _counted(matrix: np.ndarray, table: int, ours: np.ndarray, theirs: np.ndarray, codes_of) -> np.ndarray:
    """The links of a matrix that no table before this one has: pairs apart in all of these.

    The other tables' buckets do not travel with the vectors: those of linked vectors are computed
    again.
    """
    counted = matrix.copy()
    if table and matrix.any():
        rows, columns = matrix.any(axis=1), matrix.any(axis=0)
        codes = np.zeros((len(ours), table), np.int32), np.zeros((len(theirs), table), np.int32)
        codes[0][rows] = codes_of(ours[rows])[:, :table]
        codes[1][columns] = codes_of(theirs[columns])[:, :table]
        a, b = np.nonzero(matrix)
        for start in range(0, len(a), 65536):
            x, y = a[start : start + 65536], b[start : start + 65536]
            counted[x, y] = ~(codes[0][x] == codes[1][y]).any(axis=1)
    return counted


def compare(
    table: int, vectors: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray,
    codes_of, threshold: float = THRESHOLD,
) -> tuple[np.ndarray, np.ndarray]:
    """(links that count for each member, symmetric matrix of all links) of one comparison.

    Members of the first part meet those of the second; the two are the same for a bucket, or for
    a part of one with itself. ``codes_of`` gives the buckets of vectors, one column a table.
    """
    one, other = np.flatnonzero(first), np.flatnonzero(second)
    found = linked(vectors[one], vectors[other], threshold)
    found &= one[:, None] != other[None, :]
    counted = _counted(found, table, vectors[one], vectors[other], codes_of)
    links = np.zeros(len(vectors), np.int64)
    links[one] += counted @ copies[other]
    if not np.array_equal(one, other):
        links[other] += copies[one] @ counted
    whole = np.zeros((len(vectors), len(vectors)), bool)
    whole[np.ix_(one, other)] = found
    return links, whole | whole.T


def _dealt(signed: DataFrame) -> DataFrame:
    """Classes by cell: a bucket, or a pair of parts of a bucket of over PART_ROWS classes."""
    spread = signed.select(
        "class", "raw", "copies", "dims", F.posexplode("codes").alias("table", "code")
    ).withColumn("bucket", F.xxhash64("dims", "table", "code"))
    sizes = signed.select("dims", F.posexplode("codes").alias("table", "code"))
    sizes = sizes.groupBy(F.xxhash64("dims", "table", "code").alias("bucket")).count()
    # Few rows as a rule: whether they are broadcast is left to their size.
    large = settle(
        sizes.where(F.col("count") > PART_ROWS).select(
            "bucket", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")
        )
    )
    parts = F.coalesce("parts", F.lit(1))
    placed = spread.join(large, "bucket", "left").withColumn(
        "own", F.pmod(F.xxhash64("class", F.lit(7)), parts).cast("int")
    )
    carried = ["class", "raw", "copies", "dims", "table", "code"]
    pairs = placed.select(
        *carried, "bucket", "own", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    )
    return pairs.select(
        *carried,
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        (F.col("own") <= F.col("other")).alias("first"),
        (F.col("own") >= F.col("other")).alias("second"),
    )


def _links(signed: DataFrame, kind: type, signs: int, tables: int, threshold: float) -> DataFrame:
    """(a, b, n): a member of a cell with its links, b null; or two joined members, n null."""
    dealt = _dealt(signed)
    names = dealt.columns
    dealt = dealt.repartition("cell").sortWithinPartitions("cell")

    def search(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cells = table["cell"].to_numpy()
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            if done:
                yield from found(table.slice(0, done), cuts)
            rest = table.slice(done).combine_chunks()
        if rest is not None and len(rest):
            yield from found(rest, np.array([len(rest)]))

    def found(table, cuts):
        names = table["class"].to_numpy()
        copies, dims = table["copies"].to_numpy(), table["dims"].to_numpy()
        number = table["table"].to_numpy()
        first, second = (table[c].to_numpy(zero_copy_only=False) for c in ("first", "second"))
        raw = table["raw"].to_pylist()
        code = table["code"].to_numpy()
        counts, joins = ([], []), []
        start = 0
        for end in cuts.tolist():
            if end - start > 1:
                # One bucket, but for a collision of hashes: then they are taken one by one.
                kinds = np.stack([dims[start:end], number[start:end], code[start:end]], axis=1)
                for one in np.unique(kinds, axis=0):
                    at = start + np.flatnonzero((kinds == one).all(axis=1))
                    if len(at) > 1:
                        vectors = np.frombuffer(b"".join(raw[x] for x in at), kind).reshape(len(at), -1)
                        links, whole = compare(
                            int(number[at[0]]), scaled(vectors), copies[at], first[at], second[at],
                            lambda rows: buckets(rows, signs, tables), threshold,
                        )
                        some = np.flatnonzero(links)
                        counts[0].extend(names[at[some]].tolist())
                        counts[1].extend(links[some].tolist())
                        if whole.any():
                            joins += forest(whole, names[at])
            start = end
        if counts[0] or joins:
            n = len(counts[0])
            a = counts[0] + [x for x, _ in joins]
            b, links = [None] * n + [y for _, y in joins], counts[1] + [None] * len(joins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "n"]
            )

    return dealt.select(*names).mapInArrow(search, "a long, b long, n long")


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more; what links join over
    any number of steps is one component, named by its smallest key; ``kept`` are the rows that
    have that key. Rows whose vector is null, empty or all zeros, or holds a null or non-finite
    component, link with nothing and are components of their own; vectors meet only those of equal
    length. Equal rows link with each other and are rows of their own, and so are rows that share
    a key. A null key names a component only if all its keys are null. An empty table gives an
    empty one. Other columns are not read.
    """
    element = df.schema[vector].dataType.elementType.simpleString()
    kind, stored = (np.float32, "float") if element == "float" else (np.float64, "double")
    rows = df.select(
        F.col(key).cast("long").alias("_id"), F.col(vector).cast(f"array<{stored}>").alias("_vector")
    )
    small = F.forall(
        "_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    able = F.coalesce(small & F.exists("_vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_able", able)
    grouped = rows.where("_able").groupBy("_vector").agg(
        F.min("_id").alias("least"), F.count("*").alias("copies")
    )
    classes = settle(grouped.withColumn("class", F.monotonically_increasing_id()))
    signs, tables = layout(classes.count(), threshold, recall)

    def sign(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(sizes)))
            codes = np.zeros((len(sizes), tables), np.int32)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                rows = values[starts[at][:, None] + np.arange(dims)]
                codes[at] = buckets(scaled(rows), signs, tables)
            raw = [values[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            made = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(codes.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int32()),
                 pa.array(raw, pa.binary()), made],
                ["class", "copies", "dims", "raw", "codes"],
            )

    signed = settle(
        classes.select("class", "_vector", "copies").mapInArrow(
            sign, "class long, copies long, dims int, raw binary, codes array<int>"
        )
    )
    found = settle(_links(signed, kind, signs, tables, threshold))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = settle(found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n")))
    roots = settle(roots)
    about = classes.join(roots, classes["class"] == roots.node, "left").drop("node")
    about = about.withColumn("root", F.coalesce("root", "class"))
    names = settle(about.groupBy("root").agg(F.min("least").alias("component_id")))
    about = about.join(names, "root").join(counts, about["class"] == counts.a, "left")
    about = settle(
        about.select(
            F.col("_vector"), "component_id",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        )
    )
    with_links = rows.where("_able").join(about, "_vector").select("_id", "n_links", "component_id")
    alone = rows.where("NOT _able").select(
        "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")
    )
    return with_links.unionByName(alone).select(
        F.col("_id").alias(key), "n_links", "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
