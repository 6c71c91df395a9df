"""Fingerprints bit by bit; links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailgraph.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(values, links):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for v in values:
        groups.setdefault(root(v), []).append(v)
    return sorted(sorted(g) for g in groups.values())


def near_pairs(values):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]


@pytest.fixture
def prints():
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(150)}
    for start in list(values)[:40]:
        for _ in range(rng.randint(1, 12)):
            one = start
            for _ in range(rng.randint(1, 4)):
                one ^= 1 << rng.randrange(64)
            values.add(one)
    return sorted(values)


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " ", "A", "a B", "É é A", "x " * 5000] + [
        " ".join(rng.choices(["a", "B", "cc", "dé"], k=rng.randint(0, 15))) for _ in range(100)
    ]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_tree_finds_all_links(prints):
    values = np.array(prints, dtype=np.uint64)
    assert joined(prints, simhash.forest((values, values), (values, values), 3)) == joined(prints, near_pairs(prints))
    tree, pairs = simhash.BKTree(values), set()
    tree.search(values, 3, lambda node, near: pairs.update((prints[node], prints[p]) for p in near))
    assert {(a, b) for a, b in pairs if a > b} == set(near_pairs(prints))


@pytest.mark.parametrize("part", [3, 2048])
def test_links_and_components(spark, prints, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "simhash long")
    mask = (1 << 64) - 1
    links = [(r["a"] & mask, r["b"] & mask) for r in simhash.links(df).collect()]
    want = joined(prints, near_pairs(prints))
    assert joined(prints, links) == want
    groups = {}
    for row in simhash.components(simhash.links(df)).collect():
        groups.setdefault(row["root"], []).append(row["node"] & mask)
    assert sorted(sorted(g) for g in groups.values()) == [g for g in want if len(g) > 1]


def test_documents(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randint(0, 500)}" for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = "changed"
            texts.append(" ".join(words).upper())
    rows = [(n + 1, t) for n, t in enumerate(texts)] + [(0, None), (900, ""), (901, " \n"), (None, texts[0]), (5, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    mask = (1 << 64) - 1
    values = sorted({plain(t) for _, t in rows})
    names = {}
    for group in joined(values, near_pairs(values)):
        least = min(i for i, t in rows if i is not None and plain(t) in group)
        names |= {v: least for v in group}
    want = sorted(((i, plain(t), names[plain(t)]) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["simhash"] & mask, r["component_id"]) for r in out), key=str) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def likeness_groups(texts, least):
    """Groups of ids joined by a similarity of ``least`` or more, over all pairs."""
    sets = {i: five(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if similarity(sets[a], sets[b]) >= least]
    return joined(ids, links)


def test_wide_bits():
    text = " ".join(f"w{n % 700}" for n in range(900))
    words = text.encode().split()
    parts = {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    hashes = np.array([xxhash.xxh64(p, seed=42).intdigest() for p in parts], np.uint64)
    want = b""
    for n in range(simhash.WIDE_WORDS):
        mixed = simhash._mixed(hashes, n).tolist()
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed))
        want += value.to_bytes(8, "little")
    assert simhash.sketch(text.encode())[0] == want


def test_sketch():
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    whole, bands = simhash.sketch(" ".join(words).encode())
    assert (len(whole), len(set(bands))) == (128, 10)
    # Order and number of equal shingles do not count, nor does the case of A to Z.
    assert simhash.sketch(" ".join(words + words[:4] + words).upper().encode())[0] != whole
    assert simhash.sketch("  ".join(words).upper().encode()) == (whole, bands)
    assert simhash.sketch(b"a b a b a b a b a b a b") == simhash.sketch(b"a b a b a b a b")
    assert simhash.sketch(b"") == simhash.sketch(b" \n") == (bytes(128), [0] * 10)
    assert simhash.wide_radius(1.0) == 0 and 155 < simhash.wide_radius() < 180


@pytest.mark.parametrize("part", [3, 2048])
def test_similar(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    rng = random.Random(6)
    rows = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 300)}" for _ in range(200)]
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(200)] = "changed"
            rows.append(" ".join(changed).upper())
        # Shares half of its words in a row: not similar.
        rows.append(" ".join(words[:100] + [f"x{rng.randint(0, 300)}" for _ in range(100)]))
    rows.append(" ".join(f"v{n}" for n in range(60_000)))
    texts = {n + 1: t for n, t in enumerate(rows)} | {0: None, 900: "", 901: " \n", 902: "short", 903: "Short"}
    df = spark.createDataFrame([*texts.items(), (None, rows[0]), (5, texts[5])], "doc_id long, text string")
    df = df.withColumn("component_id", F.lit("clash")).withColumn("wide", F.lit(1))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    groups = likeness_groups(texts, 0.8)
    assert found == {i: min(group) for group in groups for i in group}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert sorted(set(ids)) == sorted(min(group) for group in groups)
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.similar(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [7, 2048])
def test_links_stand_on_counted_similarity(spark, monkeypatch, part):
    """Pairs on both sides of the limit; a chain of candidates does not join what is not similar."""
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    rng = random.Random(8)
    texts, near, far = {}, 0, 0
    for n in range(400):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(rng.choice([14, 30, 100, 300]))]
        other = list(words)
        # Words added at the end add one shingle each; 4 old in 5 of all is the limit.
        size = len(words) - 4
        other += [f"x{rng.randint(0, 10**9)}" for _ in range(size // 4 + n % 2)]
        texts[2 * n], texts[2 * n + 1] = " ".join(words), " ".join(other)
        likeness = similarity(five(texts[2 * n]), five(texts[2 * n + 1]))
        near, far = near + (likeness >= 0.8), far + (0.7 < likeness < 0.8)
    assert near >= 150 and far >= 150
    # A bridge of 0.78 to each of two groups: both stay apart.
    words = [f"v{n}" for n in range(204)]
    texts |= {n: " ".join(words[k : k + 204 - k]) for n, k in ((5000, 0), (5001, 22), (5002, 44))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    want = {2 * n + 1: 2 * n if similarity(five(texts[2 * n]), five(texts[2 * n + 1])) >= 0.8 else 2 * n + 1
            for n in range(400)}
    want |= {2 * n: 2 * n for n in range(400)}
    ids = (5000, 5001, 5002)
    want |= {i: min(g) for g in likeness_groups({i: texts[i] for i in ids}, 0.8) for i in g}
    assert found == want


def test_repeated_key_is_one_document(spark):
    a, b = (" ".join(f"{c}{n}" for n in range(50)) for c in "ab")
    df = spark.createDataFrame([(3, a), (3, b), (7, a), (8, b)], "doc_id long, text string")
    assert {tuple(r) for r in simhash.similar(df).collect()} == {(3, 3), (7, 3), (8, 3)}
