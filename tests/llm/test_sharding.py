"""Laws of the hash tree."""

import math
import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from mailgraph.llm import queries, sharding


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = queries.op4_weighted_hash_tree(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slots = {}
    for row in out:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert row["grown_shard"] in (row["shard"], 8) and row["law"] == "key"
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert len(out) == len(texts) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = Counter(row["grown_shard"] for row in out)
    assert all(60 < n < 170 for n in counts.values()) and len(counts) == 9


def test_odd_rows(spark):
    rows = [(None, "a"), (1, None), (1, None), (2, ""), (2, "é" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    out = sharding.place(df, sharding.layout(8), sharding.layout(9)).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 1, 2, 20001]
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    assert len({(r["shard"], r["slot"]) for r in out}) == 5
    assert sharding.place(df.limit(0), sharding.layout(8), sharding.layout(9)).count() == 0


def test_weights_move_only_what_they_must(spark):
    keys = spark.range(20_000)
    leaves = [sharding.Leaf(f"r{n // 4}", f"k{n // 2}", n, 1.0 + n % 2) for n in range(8)]
    heavier = [leaf._replace(weight=4.0) if leaf.shard == 5 else leaf for leaf in leaves]
    moved = keys.select(
        sharding.shard_of(F.col("id"), leaves).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")
    ).collect()
    shares = Counter(r["a"] for r in moved)
    assert all(abs(shares[n] / 20_000 - (1 + n % 2) / 12) < 0.01 for n in range(8))
    # Shard 5 is in the second region: nothing moves inside the first one, nothing moves into it.
    assert all(r["b"] >= 4 for r in moved if r["a"] != r["b"])
    # Inside that region, the other rack gains nothing from its neighbour.
    assert not any(r["a"] in (4, 5) and r["b"] in (6, 7) for r in moved)
    gone = [leaf for leaf in leaves if leaf.shard != 7] + [sharding.Leaf("r1", "k3", 7, 0.0)]
    assert keys.where(sharding.shard_of(F.col("id"), gone) == 7).isEmpty()


def descend(key, leaves):
    """Level by level, child by child: the least ``-ln(u) / weight`` of each node wins."""
    path, members = "", [leaf for leaf in leaves if leaf.weight > 0]
    for level in range(3):
        children = {}
        for leaf in members:
            children.setdefault((leaf.region, leaf.rack, str(leaf.shard))[level], []).append(leaf)
        best = None
        for name in sorted(children):
            h = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), 42)
            if key is not None:
                h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
            weight = sum(leaf.weight for leaf in children[name])
            draw = -math.log(((h >> 11) + 0.5) / 2**53) / weight
            if best is None or draw < best[0]:
                best = draw, name
        # The root has no name of its own; a node of one child draws nothing, which changes no winner.
        path = best[1] if level == 0 else f"{path}/{best[1]}"
        members = children[best[1]]
    return members[0].shard


@pytest.mark.parametrize("kind", ["layout", "weights"])
def test_shards_equal_plain_draws(spark, kind):
    rng = random.Random(4)
    leaves = sharding.layout(11)
    if kind == "weights":
        leaves = [leaf._replace(weight=rng.choice([0.0, 0.5, 1.0, 3.0])) for leaf in leaves]
    keys = [None, 0, -1, 2**62, *(rng.randint(-(10**9), 10**9) for _ in range(800))]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    out = df.select("id", sharding.shard_of(F.col("id"), leaves).alias("shard")).collect()
    assert [r["shard"] for r in out] == [descend(r["id"], leaves) for r in out]
    assert len({r["shard"] for r in out}) > 3
