"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailgraph.llm import bpe, queries

PATH = queries.tokenizer_path()
ODD = ["a", "b", " ", "\n", "\t", "\u3000", "\x1c", "\x85", "'s", "'ll", "1", "²", "é", "中", "!",
       "<|endoftext|>", "\0", "\r", "\xa0", "the", "😀", "é", "_", ","]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(n)]


def ids_of(packed):
    return list(memoryview(packed).cast("I"))


def test_ids_and_texts_equal_the_library(library, vocabulary):
    encode, decode = bpe.Transducer(vocabulary).encode, bpe.ByteDecoder(vocabulary.bytes_of).decode
    for text in [*odd_texts(4000), "", "a" * 7000, "ab" * 3000, "中" * 3000, " " * 999, "x" + "\n" * 50]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encode(text)) == ids, text[:80]
        assert decode(encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_window_does_not_change_the_result(vocabulary):
    rng = random.Random(2)
    text = "".join(rng.choices("etaoinshth", k=4000))
    whole = bpe.Transducer(vocabulary, step=10_000).encode(text)
    for step in (1, 7, 100):
        assert bpe.Transducer(vocabulary, step=step).encode(text) == whole


def test_lookahead_is_sufficient(vocabulary):
    """Tokens that end the lookahead before the end of a text stay, whatever follows."""
    rng = random.Random(3)
    transducer = bpe.Transducer(vocabulary, step=10_000)
    for _ in range(40):
        text = "".join(rng.choices(rng.choice(["ab", "etaoinsh", "xX"]), k=500))
        longer = text + "".join(rng.choices("etaoinshxXab", k=300))
        limit = len(text) - vocabulary.lookahead
        for short, long in zip(ids_of(transducer.encode(text)), ids_of(transducer.encode(longer))):
            limit -= len(vocabulary.bytes_of[short])
            if limit < 0:
                break
            assert short == long


def test_decoder_takes_any_cut(library, vocabulary):
    ids = library.encode("né 中文 😀!", add_special_tokens=False).ids
    decoder = bpe.ByteDecoder(vocabulary.bytes_of)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "né 中文 😀!"
    broken = ids[:-2][3:]
    assert decoder.decode(bpe.packed(broken)) == library.decode(broken, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(1, "the end"), (2, None), (3, ""), (None, "x"), (1, "the end"), (4, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == len(rows)
    for row in out:
        text = row["text"] or ""
        assert ids_of(row["ids"]) == library.encode(text, add_special_tokens=False).ids
        assert row["decoded"] == text
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op1_bpe_transducer(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for row in out:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(bpe.packed(ids)).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
