"""Bags of words, topic tables and the choice of the number of topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.operators.numbering import dense_ids

# Topic counts tried for mails and for pairs, and terms shown per topic.
MAIL_TOPIC_COUNTS = list(range(2, 50, 6))
PAIR_TOPIC_COUNTS = list(range(2, 50, 8))
TERMS_PER_TOPIC = 15


def bag_of_words(words: DataFrame, doc: str = "file_id") -> DataFrame:
    """doc, word, value: number of rows per document and word.

    A term-frequency table has one row per word, so its bags are binary; the words of a
    connection repeat over its mails and are counted.
    """
    return words.groupBy(doc, "word").agg(F.count("*").alias("value"))


def vocabulary(bow: DataFrame, min_docs: int = 1) -> DataFrame:
    """word, term_id (from 0, in word order), df. ``min_docs`` prunes rare words on request."""
    counts = bow.groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") >= min_docs)
    return dense_ids(counts, ["word"], "term_id")


def bow_cells(bow: DataFrame, vocab: DataFrame, doc: str = "file_id") -> DataFrame:
    """doc, term_id, value: the bags with their words as term ids; other words are left out."""
    numbered = bow.join(vocab.select("word", "term_id"), "word")
    return numbered.select(doc, "term_id", F.col("value").cast("double").alias("value"))


def best_terms(long: DataFrame, n: int = TERMS_PER_TOPIC) -> DataFrame:
    """topic, word, prob (4 places) of the ``n`` heaviest words per topic, ties by word."""
    order = Window.partitionBy("topic").orderBy(F.desc("prob"), "word")
    return (
        long.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n)
        .select("topic", "word", F.round("prob", 4).alias("prob"))
    )


def best_of_wide(terms: DataFrame, names: list[str], n: int = TERMS_PER_TOPIC) -> DataFrame:
    """The same from a row for each word with a column for each topic. Every batch of words gives
    only those that no ``n`` others of its own are above, so that not each word and topic is sorted."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, high = batch.column(0), max(0, batch.num_rows - n)
            for topic, column in enumerate(batch.columns[1:]):
                prob = column.to_numpy(zero_copy_only=False)
                if not len(prob):
                    continue
                at = np.flatnonzero(~(prob < np.partition(prob, high)[high]))
                topics = pa.array(np.full(len(at), topic, np.int32))
                yield pa.RecordBatch.from_arrays([topics, words.take(pa.array(at)), pa.array(prob[at])], ["topic", "word", "prob"])

    return best_terms(terms.select("word", *names).mapInArrow(best, "topic int, word string, prob double"), n)


def ranked_topics(topic_prob: DataFrame, doc: str = "file_id") -> DataFrame:
    """Add ``rank`` by falling probability; equal ones by topic number."""
    order = Window.partitionBy(doc).orderBy(F.desc("prob"), "topic")
    return topic_prob.withColumn("rank", F.row_number().over(order))


def dominant_topics(topic_prob: DataFrame, doc: str = "file_id") -> DataFrame:
    return ranked_topics(topic_prob, doc).filter("rank = 1").drop("rank")


def leading_topic_terms(topic_prob: DataFrame, topic_terms: DataFrame, doc: str = "file_id") -> DataFrame:
    """Terms of the topics that are first or second in some document."""
    leading = ranked_topics(topic_prob, doc).filter("rank <= 2").select("topic").distinct()
    return topic_terms.join(leading, "topic", "left_semi")


def best_k(scores: DataFrame) -> DataFrame:
    """The row with the highest positive coherence; of equal ones the smallest k."""
    return scores.filter("coherence > 0").orderBy(F.desc("coherence"), "k").limit(1)


def choose(models: dict, scores: dict[int, float]):
    """The topic count with the highest positive coherence, of equal ones the first, and its model."""
    k = max(scores, key=scores.get, default=None)
    if k is None or scores[k] <= 0:
        raise ValueError("no topic count has a coherence above 0")
    return k, models[k]
