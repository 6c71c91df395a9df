"""Pieces against the tokenizers library; packings against their law and the lower bound."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailgraph.llm import packing, queries

PATH = queries.tokenizer_path()


def best_fit_decreasing(items, capacity):
    """Bins of plain best-fit decreasing, item by item."""
    rooms = []
    for one in sorted(items, reverse=True):
        fits = [n for n, room in enumerate(rooms) if room >= one]
        if fits:
            rooms[min(fits, key=lambda n: rooms[n])] -= one
        else:
            rooms.append(capacity - one)
    return len(rooms)


def check_plan(sizes, steps, capacity):
    used = Counter()
    for bins, items in steps:
        assert bins > 0 and sum(items) <= capacity
        for one in items:
            used[one] += bins
    assert used == sizes
    return sum(bins for bins, _ in steps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_all_items_in_few_bins(seed):
    rng = random.Random(seed)
    items = [min(2048, max(1, int(rng.lognormvariate(rng.choice([3, 5, 6.5]), 1)))) for _ in range(4000)]
    sizes = Counter(items)
    bins = check_plan(sizes, packing.plan(dict(sizes)), 2048)
    assert packing.lower_bound(dict(sizes)) <= bins <= best_fit_decreasing(items, 2048)


def test_never_above_best_fit_decreasing():
    rng = random.Random(1)
    better = 0
    for _ in range(500):
        capacity = rng.choice([30, 100, 500])
        low, high = rng.choice([(1, capacity), (capacity // 5, capacity // 2), (capacity // 4, capacity)])
        items = [rng.randint(low, high) for _ in range(rng.randint(1, 70))]
        sizes = Counter(items)
        plain = best_fit_decreasing(items, capacity)
        assert check_plan(sizes, packing.best_fit(dict(sizes), capacity), capacity) == plain
        bins = check_plan(sizes, packing.plan(dict(sizes), capacity, nodes=300), capacity)
        assert packing.lower_bound(dict(sizes), capacity) <= bins <= plain
        better += bins < plain
    assert better > 20


def optimum(items, capacity):
    """Fewest bins, by trying everything."""
    best = [len(items)]

    def go(n, bins):
        if len(bins) >= best[0]:
            return
        if n == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[n] <= capacity and bins[b] not in bins[:b]:
                go(n + 1, [*bins[:b], bins[b] + items[n], *bins[b + 1 :]])
        go(n + 1, [*bins, items[n]])

    go(0, [])
    return best[0]


def test_small_plans_are_optimal():
    rng = random.Random(7)
    better = 0
    for _ in range(200):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(capacity // 6, capacity * 2 // 3) for _ in range(rng.randint(1, 12))]
        found = check_plan(Counter(items), packing.plan(dict(Counter(items)), capacity), capacity)
        assert found == optimum(sorted(items, reverse=True), capacity)
        better += found < best_fit_decreasing(items, capacity)
    assert better
    assert packing.plan({}) == []


def all_fillings(rest, counts):
    """Every multiset of items that fits, and those that no single exchange makes as good."""
    found = [()]
    for one in sorted(counts, reverse=True):
        found += [f + (one,) * n for f in found for n in range(1, counts[one] + 1) if sum(f) + n * one <= rest]
    def dominated(filling):
        left = Counter(counts) - Counter(filling)
        waste = rest - sum(filling)
        for size in range(1, len(filling) + 1):
            for part in combinations(filling, size):
                total = sum(part)
                least = total + 1 if size == 1 else total
                if any(least <= one <= total + waste for one in left):
                    return True
        # What still fits can be added.
        return any(one <= waste for one in left)

    return {f for f in found if not dominated(f)}


def test_fillings_are_the_undominated_ones():
    rng = random.Random(2)
    for _ in range(150):
        rest = rng.randint(1, 30)
        counts = dict(Counter(rng.randint(1, 20) for _ in range(rng.randint(0, 9))))
        found = list(packing.fillings(rest, counts, rest))
        waste = [rest - sum(f) for f in found]
        assert waste == sorted(waste) and len(found) == len(set(found))
        assert set(found) == all_fillings(rest, counts)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "néed", "a", "<|endoftext|>", "x\n"], k=rng.choice([3, 50, 900, 5000])))
             for _ in range(60)] + [None, "", "", "a" * 9000, " " * 3000]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "x"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    out = packing.pack(df, PATH).collect()
    bins, pieces = {}, {}
    for row in out:
        bins.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
        pieces.setdefault(row["doc_id"], []).append(row)
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    lengths = Counter(row["length"] for row in out)
    assert len(bins) == sum(count for count, _ in packing.plan(dict(lengths)))
    for key in range(len(texts)):
        ids = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4")
        copies = 2 if key == 3 else 1
        mine = sorted(pieces[key], key=lambda r: r["piece"])[:: copies]
        at = 0
        for n, row in enumerate(mine):
            part = ids[at : at + row["length"]]
            assert (row["piece"], row["start"], row["ids_crc32"]) == (n, at, zlib.crc32(part.tobytes()))
            assert n == 0 or row["length"] == 2048
            at += row["length"]
        assert at == len(ids) and (len(mine) == 1 or at > 2048)
    assert packing.pack(df.limit(0), PATH).count() == 0
