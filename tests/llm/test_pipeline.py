"""Each stage against a plain version of it, on what the stage before has kept."""

import zlib
from collections import Counter

import pytest
import zstandard
from test_packing import Tokenizer
from test_simhash import likeness_groups

import corpus_pipeline
from mailgraph.llm import langid, quality, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs[-1], SF_DIR)
        rows = kept.collect()
        docs.append(spark.createDataFrame(rows, kept.schema))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    learned = stages[0].where(~langid.held_out(stages[0]["doc_id"]))
    encoders = langid.compressors(langid.learn(learned))
    assert set(after) == {i for i, t in before.items() if not langid.classify(t, encoders)[3]}


def test_quality(stages):
    before, after = texts(stages[1]), texts(stages[2])
    compressor = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    want = set()
    for i, text in before.items():
        words = text.encode().split()
        grams = Counter(tuple(words[n : n + 5]) for n in range(len(words) - 4))
        inside = {n + d for n in range(len(words) - 4) if grams[tuple(words[n : n + 5])] > 1 for d in range(5)}
        if len(words) >= 10 and 100 * len(inside) <= 20 * len(words):
            if quality.band_verdict(text.encode(), compressor)[2]:
                want.add(i)
    assert set(after) == want


def test_near_duplicates(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(after) == {min(group) for group in likeness_groups(before, 0.8)}


def test_passages(stages):
    before, after = texts(stages[3]), texts(stages[4])
    words = {i: t.split() for i, t in before.items()}
    runs = Counter(tuple(w[n : n + 35]) for w in words.values() for n in range(len(w) - 34))
    assert set(before) == set(after)
    for i, w in words.items():
        gone = {n + d for n in range(len(w) - 34) if runs[tuple(w[n : n + 35])] > 1 for d in range(35)}
        want = " ".join(x for n, x in enumerate(w) if n not in gone) if gone else before[i]
        assert after[i] == want


def test_packing(stages):
    library = Tokenizer.from_file(queries.tokenizer_path())
    pieces = stages[5].collect()
    lengths = Counter()
    for row in pieces:
        lengths[row["doc_id"]] += row["length"]
    for i, text in texts(stages[4]).items():
        assert lengths[i] == len(library.encode(text, add_special_tokens=False).ids) + 1
    used = Counter()
    for row in pieces:
        used[row["sequence_id"]] += row["length"]
    assert max(used.values()) <= 2048


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).select(columns).collect()))
    assert a == sorted(map(tuple, stages[5].select(columns).collect()))
    assert zlib.crc32(b"") == 0


def odd_rows(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, one more column."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40).collect()
    plain = [tuple(r) for r in docs]
    long = " ".join(r["text"] for r in docs if r["text"]) * 12
    rows = plain + plain[:3] + [(900, None, None, None, None), (901, "", "en", "x", 0), (901, "", "en", "x", 0),
                                (None, plain[5][1], "en", "x", 9), (plain[6][0], plain[7][1], "en", "x", 9),
                                (902, long, "en", "x", len(long)), (903, "12 ² !", None, "x", 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr("*", "'more' AS spans", "1 AS _text_")


def test_odd_rows_pass_every_stage(spark):
    docs = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        rows = kept.collect()
        if name != "repeated passages":
            assert kept.columns == docs.columns
            assert not Counter(map(tuple, rows)) - Counter(map(tuple, docs.collect()))
        else:
            assert kept.columns == docs.columns and len(rows) == docs.count()
        docs = spark.createDataFrame(rows, kept.schema)
    # A text without letters has no language, one without words no quality.
    assert not {r["doc_id"] for r in docs.collect()} & {900, 901, 903}
    packed = corpus_pipeline.STAGES[-1][1](spark, odd_rows(spark), SF_DIR)
    assert packed.select("doc_id").distinct().count() == odd_rows(spark).select("doc_id").distinct().count()


def test_empty_tables_pass_every_stage(spark):
    docs = odd_rows(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).isEmpty()
