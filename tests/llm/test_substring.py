"""Repeats against all windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailgraph.llm import substring


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone).decode()
        out.append((key, len(w), len(gone), kept))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dé", "e\xa0f", "the"]

    def some(n, k=6):
        return " ".join(rng.choices(vocabulary[:k], k=n))

    passages = [some(60).split() for _ in range(6)]
    out = []
    for n in range(150):
        text = some(rng.randint(0, 80))
        if rng.random() < 0.5:
            start = rng.randint(0, 30)
            text += " \n" + " ".join(rng.choice(passages)[start : start + rng.randint(20, 50)]) + "\t" + some(10)
        out.append((n, text))
    return out + [(200, None), (201, ""), (202, "x " * 100), (203, out[5][1]), (203, out[5][1]),
                  (None, out[6][1]), (204, some(300, 2)), (205, some(20_000, 6))]


@pytest.mark.parametrize("window, prefix, size", [(35, 8, 3000), (35, 8, 2 << 20), (12, 5, 3000), (12, 12, 500)])
def test_equals_all_windows(spark, rows, monkeypatch, window, prefix, size):
    monkeypatch.setattr(substring, "CHUNK_BYTES", size)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    out = substring.remove_repeats(df, window=window, prefix=prefix).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_words"]) for r in out), key=str) == brute(rows, window)
    for r in out:
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]
        assert all(a["to"] < b["from"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_untouched_texts_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, " a\n\tb ", "x"), (2, None, None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in substring.remove_repeats(df).collect()}
    assert out[1]["text"] == " a\n\tb " and out[1]["kept_words"] == "a b" and out[1]["lang"] == "x"
    assert out[2]["text"] is None and out[2]["kept_words"] == ""
    assert substring.remove_repeats(df.limit(0)).count() == 0
