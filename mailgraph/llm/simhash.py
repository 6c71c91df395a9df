"""Near-duplicates by SimHash: fingerprints linked through BK-trees, links joined to components.

Two fingerprints that differ in at most RADIUS of 64 bits agree on at least two of five bit
fields, so every link lies inside a shard of fingerprints with two equal fields. Each shard gets
a BK-tree, and the fingerprints of the shard are searched in it, following only the edges whose
distance can hold a partner. A shard that is too large for one task is cut into parts, and each
pair of parts is a tree and its queries. A task gives back only links that join what it has not
joined yet, so a cluster of n fingerprints costs n links and not n * n.

``near_duplicates`` links fingerprints of RADIUS bits. ``similar`` links texts of which four in
five shingles or more are the same: they differ in far more than three of 64 bits, so it takes a
fingerprint of 1,024 bits, a wide radius around that similarity, and shards of texts that share a
band of smallest shingle hashes. What these find are candidates: texts that candidates join meet
again with their sets of shingles, and only pairs whose sets were compared become links.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.llm.common import append_columns, texts_of, words
from mailgraph.session import settle

SHINGLE, SEED, RADIUS = 3, 42, 3
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits)
# Fingerprints of one tree, and of one block of queries, at most.
PART_ROWS = 2048
# Bytes of shingle sets in a part, about.
PART_BYTES = 64 * 2**20
# Similar texts: words of a shingle, least share of common shingles, 64-bit words of a fingerprint.
SIMILAR_SHINGLE, SIMILARITY, WIDE_WORDS = 5, 0.8, 16
# A pair of that similarity shares one of the bands with a chance of 99.5 %, the more similar
# the surer; its fingerprint lies within the radius unless it strays by over SPREAD deviations.
BANDS, BAND_ROWS, SPREAD = 10, 4, 1.645
# Candidates for the comparison of sets: a pair of that similarity shares one of so many bands but
# for a chance of 0.003 %, and the radius leaves room for small sets, whose bits stray further.
SEARCH_BANDS, SEARCH_SPREAD = 20, 8.0


def shingles(tokens: list[bytes], size: int = SHINGLE) -> list[bytes]:
    if len(tokens) <= size:
        return [b" ".join(tokens)] if tokens else []
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the shingles of a text, each as often as it occurs; 0 without words."""
    parts = shingles(words(text.lower()), size)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(part, SEED) for part in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        block = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """Append the fingerprint of every whole text as a signed 64-bit number.

    Null and empty texts, and texts without words, have fingerprint 0. A column of ``df`` named
    like the new one is replaced, others stay. Equal texts give equal fingerprints, an empty table
    an empty one.
    """

    def prints(column):
        values = [fingerprint(value) for value in texts_of(column)]
        return [np.array(values, dtype=np.uint64).view(np.int64).tolist()]

    return append_columns(df, [text], f"`{name}` long", prints)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """The ``number``-th family of hashes made of 64-bit hashes."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (number + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_radius(similarity: float = SIMILARITY, spread: float = SPREAD) -> int:
    """Bits in which fingerprints of texts of this similarity differ, and ``spread`` deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE_WORDS
    return int(bits * share + spread * math.sqrt(bits * share * (1 - share)))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the SIMILAR_SHINGLE-word shingles."""
    parts = set(shingles(words(text.lower()), SIMILAR_SHINGLE))
    hashes = np.fromiter((xxhash.xxh64_intdigest(part, SEED) for part in parts), "<u8", len(parts))
    return np.unique(hashes)


def alike(a: bytes, b: bytes) -> bool:
    """Whether two shingle sets, as bytes, have a similarity of SIMILARITY or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 8:
        return False
    one, other = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    common = len(np.intersect1d(one, other, assume_unique=True))
    union = len(one) + len(other) - common
    return not union or common / union >= SIMILARITY


def sketch(text: bytes, count: int = BANDS) -> tuple[bytes, list[int]]:
    """Fingerprint of 64 * WIDE_WORDS bits of the set of shingles, and its bands of least hashes.

    A text without words has fingerprint zero and bands zero.
    """
    return _sketch(shingle_set(text), count)


def _sketch(hashes: np.ndarray, count: int) -> tuple[bytes, list[int]]:
    if not len(hashes):
        return bytes(8 * WIDE_WORDS), [0] * count
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    least = np.full(count * BAND_ROWS, 2**64 - 1, np.uint64)
    factors = _mixed(np.arange(len(least), dtype=np.uint64), WIDE_WORDS) | np.uint64(1)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096]
        mixed = np.stack([_mixed(block, n) for n in range(WIDE_WORDS)], axis=1)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        # Eight counters of a byte each are added at once; 255 rows cannot overflow them.
        for row in range(0, len(bits), 255):
            ones += np.add.reduce(bits[row : row + 255], axis=0).view(np.uint8)
        for n, factor in enumerate(factors):
            least[n] = min(least[n], (block * factor).min())
    wide = np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()
    bands = [
        xxhash.xxh64_intdigest(least[n * BAND_ROWS : (n + 1) * BAND_ROWS].tobytes(), n)
        for n in range(count)
    ]
    return wide, np.array(bands, np.uint64).view(np.int64).tolist()


def distances(values: np.ndarray, one) -> np.ndarray:
    apart = np.bitwise_count(values ^ one)
    return apart if apart.ndim == 1 else apart.sum(axis=1, dtype=np.int64)


def _number(value: np.ndarray) -> int:
    return int.from_bytes(value.tobytes(), "little")


class BKTree:
    """Nodes keyed by their distance to the parent, built and searched in bulk."""

    def __init__(self, values: np.ndarray):
        self.values = values
        # (node, its subtrees: distance -> first place in the list of nodes)
        self.nodes: list[tuple[int, dict[int, int]]] = []
        pending = [(np.arange(len(values)), None, 0)] if len(values) else []
        while pending:
            members, parent, edge = pending.pop()
            place = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1][edge] = place
            node, rest = int(members[0]), members[1:]
            self.nodes.append((node, {}))
            if len(rest):
                apart = distances(values[rest], values[node])
                for d in np.unique(apart):
                    pending.append((rest[apart == d], place, int(d)))

    def search(self, queries: np.ndarray, radius: int, found) -> None:
        """Calls ``found(node, places of the queries within the radius)``."""
        pending = [(0, np.arange(len(queries)))] if self.nodes and len(queries) else []
        while pending:
            place, asking = pending.pop()
            node, edges = self.nodes[place]
            apart = distances(queries[asking], self.values[node]).astype(np.int64)
            near = asking[apart <= radius]
            if len(near):
                found(node, near)
            for edge, child in edges.items():
                follow = asking[np.abs(apart - edge) <= radius]
                if len(follow):
                    pending.append((child, follow))


def forest(tree: tuple, queries: tuple, radius: int, sure=None) -> list[tuple]:
    """Links (a, b) that join all that lies within the radius, none that closes a circle.

    ``tree`` and ``queries`` are (names, fingerprints); a fingerprint is a number or a row of them.
    With ``sure(place in the tree, place in the queries)`` only pairs for which it holds are linked.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    tree_names, query_names = tree[0].tolist(), queries[0].tolist()

    def found(node: int, near: np.ndarray) -> None:
        one = tree_names[node]
        for place in near.tolist():
            other = query_names[place]
            if other != one:
                a, b = root(one), root(other)
                if a != b and (sure is None or sure(node, place)):
                    parent[max(a, b)] = min(a, b)
                    links.append((one, other))

    BKTree(tree[1]).search(queries[1], radius, found)
    return links


def _shard_keys(value):
    """Two fields of the fingerprint and their numbers, for every two fields."""
    field = [
        F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1)) for low, bits in FIELDS
    ]
    return F.array(
        *[
            F.shiftleft(field[a], 13).bitwiseOR(field[b]).bitwiseOR(F.lit(n << 26))
            for n, (a, b) in enumerate(combinations(range(len(FIELDS)), 2))
        ]
    )


def links(prints: DataFrame, name: str = "simhash") -> DataFrame:
    """Links (a, b) between distinct fingerprints that join everything within RADIUS bits.

    ``prints`` holds distinct fingerprints. Shards are counted first; those over PART_ROWS are
    cut into parts by a hash, and each fingerprint goes to all pairs of parts with its own.
    """
    spread = prints.select(F.col(name).alias("a"), F.explode(_shard_keys(F.col(name))).alias("shard"))
    return _links_in_shards(spread, RADIUS)


def _links_in_shards(spread: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the names ``a`` that share a ``shard`` within the radius.

    The fingerprint is the name itself or, if there is one, the column ``wide``. Where there is
    a column ``hashes``, the shingle sets, a pair within the radius is linked only if they agree.
    """
    carried = [c for c in spread.columns if c != "shard"]
    exact = "hashes" in carried
    size = F.sum(F.octet_length("hashes")) if exact else F.lit(0)
    sizes = spread.groupBy("shard").agg(F.count("*").alias("rows"), size.alias("bytes")).where("rows > 1")
    number = F.ceil(F.greatest(F.col("rows") / PART_ROWS, F.col("bytes") / PART_BYTES))
    parts = settle(sizes.select("shard", number.cast("int").alias("parts")))
    # The hash that deals out the parts must differ from the one that deals out the shards.
    own = F.pmod(F.xxhash64(F.col("a"), F.lit(7)), F.col("parts")).cast("int")
    placed = spread.join(parts, "shard").withColumn("own", own)
    pairs = placed.select(
        *carried, "shard", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        *carried,
        # One number for a shard and a pair of its parts; two pairs that get the same number by
        # chance only share a task.
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        (F.col("own") <= F.col("other")).alias("first"),
        (F.col("own") >= F.col("other")).alias("second"),
    )
    dealt = pairs.repartition("cell").sortWithinPartitions("cell")

    def search(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cells = table["cell"].to_numpy()
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1 if len(cells) else np.array([], int)
            done = int(cuts[-1]) if len(cuts) else 0
            yield from found(table.slice(0, done), cuts)
            rest = table.slice(done).combine_chunks()
        if rest is not None and len(rest):
            yield from found(rest, np.array([len(rest)]))

    def found(table, cuts):
        if not len(table):
            return
        name = table["a"].to_numpy()
        value = name.view(np.uint64)
        if "wide" in carried:
            value = np.frombuffer(b"".join(table["wide"].to_pylist()), "<u8").reshape(len(name), -1)
        first = table["first"].to_numpy(zero_copy_only=False)
        second = table["second"].to_numpy(zero_copy_only=False)
        sets = table["hashes"].to_pylist() if exact else None
        out: list[tuple] = []
        start = 0
        for end in cuts.tolist():
            if end - start > 1:
                at, v, f, s = (x[start:end] for x in (name, value, first, second))
                if end - start == 2:
                    near = at[0] != at[1] and (_number(v[0]) ^ _number(v[1])).bit_count() <= radius
                    if near and (not exact or alike(sets[start], sets[start + 1])):
                        out.append((int(at[0]), int(at[1])))
                else:
                    sure = None
                    if exact:
                        ours, theirs = np.flatnonzero(f) + start, np.flatnonzero(s) + start

                        def sure(node, place, ours=ours, theirs=theirs):
                            return alike(sets[ours[node]], sets[theirs[place]])

                    out += forest((at[f], v[f]), (at[s], v[s]), radius, sure)
            start = end
        if out:
            both = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return dealt.select(*carried, "cell", "first", "second").mapInArrow(search, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    """Number and hash sum of distinct edges: equal, but for chance in 2^64, only if they are."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b); the root is the smallest node.

    Alternates two star steps until no edge changes: every node hands its larger, then its
    smaller neighbours to the smallest one it knows. Both are one grouping by node; the edge list
    never grows, and a hub's neighbours are combined by a minimum and a join, never collected.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _state(edges)
    while True:
        # Large star: neighbours larger than the node are linked to the smallest around it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = settle(large.distinct())
        # Small star: neighbours not larger than the node, and the node, are linked to the smallest.
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(least.select("u", F.col("m").alias("v")))
        small = settle(small.distinct())
        if (state := _state(small)) == before:
            break
        edges, before = small, state
    roots = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``simhash``, ``component_id``) for every row.

    Rows whose fingerprints are linked, over any number of links, are one component, named by
    its smallest key. Rows without words share fingerprint 0, which is linked like any other.
    Null texts have no words; a null key is never a component's name unless all its keys are
    null. Equal rows stay as often as they came; an empty table gives an empty one. Other columns
    are not read.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # Keys and fingerprints alone are kept; texts are read once and not shuffled.
    prints = settle(with_fingerprints(rows, "_text").select("_key", "simhash"))
    distinct = settle(prints.groupBy("simhash").agg(F.min("_key").alias("least")))
    roots = settle(components(links(distinct.select("simhash"))))
    placed = distinct.join(roots, distinct.simhash == roots.node, "left").select(
        "simhash", "least", F.coalesce("root", "simhash").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = settle(placed.join(names, "root").select("simhash", "component_id"))
    return prints.join(lookup, "simhash").select(F.col("_key").alias(key), "simhash", "component_id")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``component_id``) for every row with a key; the keys are whole numbers.

    Rows are linked if the sets of their SIMILAR_SHINGLE-word shingles have a similarity of
    SIMILARITY or more. Fingerprints and bands find the candidates (a pair right at the limit is
    missed with a chance of less than 0.01 %, unless other links join it); the sets of hashes of
    64 bits decide. Everything linked over any number of links is one component, named by its
    smallest key. Rows that share a key are one document. Null texts have no words; all rows
    without words are alike. Rows without a key are left out; an empty table gives an empty one.
    The set of a very long text, 8 bytes a shingle, is held whole by the tasks that compare it, and
    an Arrow batch holds those of BATCH_ROWS texts. Other columns are not read.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")
    )

    def sketches(column):
        sets = [shingle_set(value) for value in texts_of(column)]
        made = [_sketch(hashes, SEARCH_BANDS) for hashes in sets]
        digests = [xxhash.xxh3_128_digest(hashes.tobytes()) for hashes in sets]
        return [digests, [wide for wide, _ in made], [bands for _, bands in made]]

    def sets(column):
        made = [shingle_set(value).tobytes() for value in texts_of(column)]
        return [[xxhash.xxh3_128_digest(hashes) for hashes in made], made]

    prints = append_columns(rows, ["_text"], "digest binary, wide binary, bands array<long>", sketches)
    prints = settle(prints.select("_key", "digest", "wide", "bands"))
    # Copies meet here, once for each task; what is left differs in its shingles.
    distinct = settle(prints.groupBy("digest", "wide", "bands").agg(F.min("_key").alias("a")))
    radius = wide_radius(spread=SEARCH_SPREAD)
    spread = distinct.select("a", "wide", F.explode("bands").alias("shard"))
    near = settle(components(_links_in_shards(spread, radius)))
    # What candidates join meets again with its set, and links are chosen among checked pairs.
    asked = distinct.join(near, distinct.a == near.node).select(
        F.col("a").alias("_key"), "digest", "wide", F.col("root").alias("shard")
    )
    again = append_columns(rows.join(asked, "_key"), ["_text"], "own binary, hashes binary", sets)
    again = again.where("own = digest").select("_key", "digest", "wide", "shard", "hashes")
    # Equal rows bring the same set again.
    again = again.groupBy("_key", "digest").agg(*[F.first(c).alias(c) for c in ("wide", "shard", "hashes")])
    checked = settle(again.select(F.col("_key").alias("a"), "wide", "shard", "hashes"))
    roots = settle(components(_links_in_shards(checked, radius)))
    # Repeated keys can stand behind several sets; their rows are one document.
    same = prints.join(distinct.select("digest", "a"), "digest").select("_key", "a").distinct()
    placed = same.join(roots, same.a == roots.node, "left")
    return placed.groupBy("_key").agg(F.min(F.coalesce("root", "a")).alias("component_id")).select(
        F.col("_key").alias(key), "component_id"
    )


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every group of similar ones: the one with the smallest key.

    Rows that share that key are the same document and all stay, and so do rows without a key.
    """
    found = similar(df, key, text)
    gone = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return df.join(settle(gone), key, "left_anti")
