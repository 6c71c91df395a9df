"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgraph.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, longest):
    w = tokens(text)
    return [" ".join(w[n : n + size]) for size in range(1, longest + 1) for n in range(len(w) - size + 1)]


def brute(rows, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024):
    place = lambda x: zlib.crc32(x.encode()) % buckets
    own = Counter(place(x) for _, text in rows for x in runs(text, longest))
    wanted = Counter(place(x) for text in target for x in runs(text, longest))
    s, t = sum(own.values()), sum(wanted.values())
    out = []
    for name, text in rows:
        found = [
            math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
            for b in map(place, runs(text, longest))
        ]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(found), weight, score, len(tokens(text)) >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    ranks = {id(r): n for n, r in enumerate(drawn, 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Mail", "ÄÖ", "ärger", "x9", "graph", "naïve", "日本", "of", "to"]
    glue = [" ", ", ", "\x00", "\t", "-", "_", "\n", " "]
    return ["".join(w + rng.choice(glue) for w in rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 35), (1, 100), (1, 0)])
def test_equals_plain_loops(spark, longest, percent):
    rows = list(enumerate(texts(300, 1))) + [(400, None), (401, ""), (None, "the mail " * 30)]
    rows += [(3, rows[3][1])] * 4 + [(5, "graph " * 25), (6, " ".join(["word"] * 30_000))]
    target = texts(20, 2) + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'r' AS _row", "2 AS rank")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(df, goal, percent=percent, longest=longest)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 5
    assert rows_of(out) == brute(rows, target, percent, longest=longest)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 40), (2, "b " * 40)], "doc_id long, text string")
    goal = df.select("text")
    assert resample.resample(df.limit(0), goal).count() == 0
    out = resample.resample(df, goal.limit(0), percent=50)
    assert rows_of(out) == brute([(1, "a " * 40), (2, "b " * 40)], [], 50)


@pytest.mark.parametrize("ties", [1, 40, 5000])
def test_cutoff_is_the_exact_key(spark, monkeypatch, ties):
    monkeypatch.setattr(resample, "LAST_KEYS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = random.Random(ties)
        keys = [(rng.randint(-9, 9) // ties, rng.randint(0, 5), n) for n in range(3000)]
        df = spark.createDataFrame(keys, "a long, b long, c long").repartition(7).orderBy(F.rand(1)).cache()
        for k in (1, 2, 16, 17, 1234, 2999, 3000):
            assert resample.cutoff(df, k) == sorted(keys)[k - 1]
        assert resample.cutoff(df, 0) is None and resample.cutoff(df, 3001) is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_pivot_discards_an_eighth():
    rng = np.random.default_rng(5)
    values = np.sort(rng.integers(0, 10**6, 20_000))
    chunks = np.array_split(rng.permutation(values), 97)
    groups = [chunks[n::6] for n in range(6)]
    tops, sizes = [], []
    for group in groups:
        weights = np.array([len(c) for c in group])
        tops.append(resample._median(np.array([resample._median(c[:, None]) for c in group]), weights))
        sizes.append(weights.sum())
    pivot = resample._median(np.array(tops), np.array(sizes))[0]
    assert len(values) / 8 <= np.searchsorted(values, pivot) <= len(values) * 7 / 8


def test_texts_near_the_target_are_drawn_more_often(spark):
    rng = random.Random(9)
    near, far = ["mail graph node edge".split(), "soup salt pan oil".split()]
    rows = [(n, " ".join(rng.choices(near if n % 2 else far, k=40))) for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(" ".join(rng.choices(near, k=500)),)], "text string")
    drawn = resample.resample(df, goal).where("rank IS NOT NULL").collect()
    assert len(drawn) == 40 and sum(r["doc_id"] % 2 for r in drawn) > 30
