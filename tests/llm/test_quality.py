"""Base counts against plain loops; the bands on clean and broken texts."""

import os
import random
import re
from base64 import b64encode
from collections import Counter

from mailgraph.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    inside = {i + d for i, g in enumerate(grams) if counts[g] > 1 for d in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    failed = n < 10 or 100 * len(inside) > 20 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed)


def test_counts_equal_plain_loops(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "é中\xa0x \x1c y\x85z", "a b c d e a b c d e", "x " * 3000]
    texts += ["".join(rng.choices(["a ", "b ", "cc ", "\n", "# ", "é|", "\t", "d e "], k=rng.randint(0, 80)))
              for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS kept")
    out = quality.assess(df).collect()
    assert len(out) == len(texts)
    for row in out:
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute(texts[row["doc_id"]]), row
        assert not (row["kept"] and row["base_failed"])
    assert quality.assess(df.limit(0)).count() == 0


def test_many_different_words_are_counted_exactly():
    words = [str(n).encode() for n in range(9000)]
    assert quality.repeated_words(words) == 0
    assert quality.repeated_words(words + words[:7]) == 14


def prose(seed, n):
    rng = random.Random(seed)
    parts = ["the", "in", "er", "con", "ta", "lo", "me", "st", "re", "a", "pu", "dis"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_bands(spark):
    noise = b64encode(os.urandom(30_000)).decode()
    spaced = " ".join(os.urandom(6).hex() + chr(200 + n % 90) for n in range(800))
    loop = " ".join(f"item {n % 9} of nine and {'so on ' * 3}" for n in range(300))
    good = {n: prose(n, n) for n in (20, 60, 200, 1000, 5000, 60_000)}
    rows = [(n, t) for n, t in good.items()] + [(-1, "word " * 12 + noise), (-2, loop), (-3, spaced)]
    rows.append((-4, good[5000] + " " + noise[:12000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept == set(good) | ({-3} & kept)


def test_short_rest_does_not_drop_a_clean_text(spark):
    sizes = [4095, 4096, 4097, 4100, 6143, 6144, 8192, 8194, 12_289, 16_385]
    rows = [(n, prose(n, 4000)[: n - 1] + "e") for n in sizes]
    noise = b64encode(random.Random(7).randbytes(3000)).decode()
    # A rest of noise that is a third of the text still counts.
    rows.append((-1, prose(2, 4000)[:8192] + noise))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality.assess(df).collect()}
    assert all(len(text) == n for n, text in rows if n > 0)
    assert {n for n in out if out[n]["kept"]} == set(sizes)
    assert max(out[n]["bad_chunks"] for n in sizes) < 0.01
    assert abs(out[-1]["bad_chunks"] - 4000 / 12_192) < 1e-9


def test_clean_documents_stay(spark):
    """Prose that passes the base rules is not touched by the bands."""
    out = queries.op3_compression_bands(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = out.join(labels, "doc_id").where("NOT base_failed")
    assert clean.where("NOT kept").isEmpty() and not clean.isEmpty()
