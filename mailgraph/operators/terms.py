"""Term frequency, IDF, TF-IDF and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.functions.numeric import product4, ratio4, smooth_idf
from mailgraph.functions.tokens import each_word
from mailgraph.sources.tables import not_in


def term_frequency(docs: DataFrame, words: str = "tokens") -> DataFrame:
    """file_id, word, abs_tf, rel_tf (4 places), status.

    Whole documents are dealt out by their id, so their words are counted without a shuffle of
    their own. The document length travels with its words.
    """
    dealt = docs.select("file_id", F.col(words).alias("tokens")).repartition("file_id")
    return (
        dealt.select("file_id", F.size("tokens").cast("bigint").alias("n"), each_word("tokens"))
        .filter("word is not null")
        .groupBy("file_id", "word", "n")
        .agg(F.count("*").alias("abs_tf"))
        .select(
            "file_id",
            "word",
            "abs_tf",
            ratio4(F.col("abs_tf"), F.col("n")).alias("rel_tf"),
            F.lit(None).cast("string").alias("status"),
        )
    )


def long_words(docs: DataFrame, words: str = "tokens") -> DataFrame:
    """One row per token occurrence."""
    return docs.select("file_id", each_word(words)).filter("word is not null")


def without_words(rows: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Long-form stop-word removal for lists too long to be a literal."""
    return not_in(rows, stop_words, ["word"])


def document_count(tf: DataFrame):
    """Number of documents as a one-value subquery column."""
    return tf.agg(F.count_distinct("file_id").alias("n")).scalar()


def idf(tf: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """word, idf, df. With ``frozen``, words already there keep their old values."""
    fresh = (
        tf.groupBy("word")
        .agg(F.count("*").alias("df"))
        .select("word", smooth_idf(document_count(tf), F.col("df")).alias("idf"), "df")
    )
    if frozen is None:
        return fresh
    return frozen.select("word", "idf", "df").unionByName(not_in(fresh, frozen, ["word"]))


def word_tfidf(tf: DataFrame) -> DataFrame:
    """One value per word: its rel_tf in the first document holding it, times its idf."""
    per_word = tf.groupBy("word").agg(
        F.count("*").alias("df"), F.min_by("rel_tf", "file_id").alias("first_tf")
    )
    value = product4(F.col("first_tf"), smooth_idf(document_count(tf), F.col("df")))
    return per_word.select("word", value.alias("tf_idf"))


def doc_tfidf(tf: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Standard form: one value per document and word. ``idf_table`` is a stored table."""
    return tf.join(idf_table.select("word", "idf"), "word").select(
        "file_id", "word", product4(F.col("rel_tf"), F.col("idf")).alias("tf_idf")
    )


def top_terms(tf: DataFrame, tfidf: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` highest-valued words of every document, ties by word.

    ``tfidf`` is a stored table of word values. The window keeps ``n`` rows per document and
    task before its shuffle.
    """
    scored = tf.select("file_id", "word").join(tfidf, "word")
    best = Window.partitionBy("file_id").orderBy(F.desc("tf_idf"), "word")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
