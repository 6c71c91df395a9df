"""Held-out accuracy and the rules around it."""

import math
import unicodedata
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from mailgraph.llm import langid, queries


def test_query_is_right_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = queries.op9_compression_language(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1 and row["lang_pred"] in ("en", "fr", "de", "es", "und")
    held = [r for r in rows if r["held_out"] and r["n"] > 60]
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.98 * len(held)
    assert sum(r["rejected"] for r in held) < 0.01 * len(held)


def test_odd_texts(spark):
    rows = [(1, "le chat et la souris dorment ici " * 20, "fr"), (2, "the cat and the mouse sleep here " * 20, "en"),
            (3, None, None), (4, "", "xx"), (5, "123 !!", "en"), (6, "the mouse", None), (6, "the mouse", None),
            (7, "the cat " * 50_000, None), (None, "le chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(df)
    assert set(model) == {"en", "fr"}
    out = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert [out[n]["lang_pred"] for n in (1, 2, 3, 4, 5, 6, 7)] == ["fr", "en", "und", "und", "und", "en", "en"]
    assert out[3]["score"] == 0 and out[3]["rejected"]
    assert langid.predict(df, {}).where("lang_pred <> 'und'").isEmpty()
    assert langid.learn(df.limit(0)) == {}
    assert langid.predict(df.limit(0), model).count() == 0
    assert langid.keep_sure(df).columns == df.columns


def test_held_out_documents_are_not_learned_from(spark):
    rows = [(n, f"palabra{n} " * 40, "es") for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = b"".join(langid.learn(df.where(~langid.held_out(F.col("doc_id")))).values())
    for n in range(40):
        assert (zlib.crc32(str(n).encode()) % 4 != 2) or f"palabra{n} ".encode() not in learned


@pytest.mark.parametrize("text", ["12", "\u00b2 12", "\u2460 \u00bd", "\u2167", "_ -", "\u0301", "\u4e00", "a1", "x"])
def test_only_letters_count(text):
    model = {"en": b"the cat sleeps here", "fr": b"le chat dort ici"}
    has_letter = any(unicodedata.category(c).startswith("L") for c in text)
    assert (langid.classify(text, langid.compressors(model))[0] != "und") == has_letter


def plain_sizes(text, model):
    """Blocks of the folded text, each compressed by itself with plain zstandard."""
    kept = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower())
    data = f" {' '.join(kept.split())} ".encode()
    sizes = {}
    for name, content in model.items():
        found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        found.precompute_compress(level=langid.LEVEL)
        encoder = zstandard.ZstdCompressor(
            level=langid.LEVEL, dict_data=found, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        sizes[name] = sum(len(encoder.compress(data[n : n + langid.BLOCK])) for n in range(0, len(data), langid.BLOCK))
    return sizes


def test_sizes_and_scores_equal_plain_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    for row in langid.predict(docs, model).collect():
        if not any(unicodedata.category(c).startswith("L") for c in row["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        sizes = plain_sizes(row["text"], model)
        least = min(sizes.values())
        assert sizes[row["lang_pred"]] == least
        assert row["score"] == pytest.approx(1 / sum(math.exp((least - n) / langid.SCALE) for n in sizes.values()))
        second = sorted(sizes.values())[1]
        assert row["rejected"] == ((second - least) / second < langid.NARROW)


def test_an_id_is_learned_from_once_whatever_its_rows(spark):
    rows = [(1, f"wort{n} " * 60, "de") for n in range(50)] + [(2, "haus " * 60, "de"), (None, "baum " * 30_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = langid.learn(df)["de"]
    assert first == langid.learn(df.repartition(9))["de"]
    assert b"haus" in first and b"baum" in first and len(first) == langid.DICTIONARY_BYTES
    assert len({w for w in first.split() if w.startswith(b"wort")}) <= 1
