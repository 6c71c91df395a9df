"""Shards by a weighted hash tree: region, then rack, then shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the child and the key,
and the least draw wins, so a child is taken in proportion to its weight. A draw depends on its
own child only: if one weight changes, no key moves between the other children of that node, and
the subtrees whose weights stay as they are keep all they have but what leaves them for good.
A new shard in a region of its own therefore takes keys only into itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.operators.numbering import position_in_group
from mailgraph.session import settle


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 8) -> list[Leaf]:
    """``base`` shards as pairs in racks and pairs of racks in regions; each one beyond it opens
    a region of its own, so that going from n to n + 1 (n >= base) moves keys to the new one only."""
    inner = min(shards, base)
    leaves = [Leaf(f"region{n // 4}", f"rack{n // 2}", n) for n in range(inner)]
    return leaves + [Leaf(f"alone{n}", f"alone{n}", n) for n in range(inner, shards)]


def _draw(node: str, key: list[Column], weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node), *key), 11)
    return -F.ln((bits + 0.5) / float(1 << 53)) / F.lit(float(weight))


def _winner(children: list[tuple[str, float, Column]], path: str, key: list[Column]) -> Column:
    """The value of the child with the least draw. ``children``: name, weight, value."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        F.struct(_draw(f"{path}/{name}", key, weight).alias("draw"), F.lit(n).alias("n"))
        for n, (name, weight, _) in enumerate(children)
    ]
    taken = F.array_min(F.array(*draws))["n"]
    value = F.when(taken == 0, children[0][2])
    for n, (_, _, child) in enumerate(children[1:], 1):
        value = value.when(taken == n, child)
    return value


def shard_of(key: Column | list[Column], leaves: list[Leaf]) -> Column:
    """The shard of a key. Leaves without weight take nothing; null keys are a key like any other."""
    keys = key if isinstance(key, list) else [key]
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        return F.lit(None).cast("int")

    def total(members: list[Leaf]) -> float:
        return sum(leaf.weight for leaf in members)

    tops = []
    for region, racks in sorted(regions.items()):
        inner = []
        for rack, members in sorted(racks.items()):
            ends = [(str(leaf.shard), leaf.weight, F.lit(leaf.shard)) for leaf in members]
            inner.append((rack, total(members), _winner(ends, f"{region}/{rack}", keys)))
        weight = sum(total(members) for members in racks.values())
        tops.append((region, weight, _winner(inner, region, keys)))
    return _winner(tops, "", keys).cast("int")


def place(
    df: DataFrame, leaves: list[Leaf], grown: list[Leaf], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The key alone decides about ``shard`` (by ``leaves``) and ``grown_shard`` (by ``grown``).
    ``size`` is the text's UTF-8 bytes plus 1; a null text is empty. ``slot`` numbers the rows of
    a shard from 0 without gaps. Rows with equal keys share a shard and get a slot each; an empty
    table gives an empty one. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), leaves).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
    )
    numbered = position_in_group(settle(narrow), ["shard"], ["_key", "text_crc32"], "place")
    return numbered.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
    )
