"""Documents to packed sequences in five stages, each written as a table and read again.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last keep the columns
of ``documents``. Language and quality drop documents, near-duplicates keep one document of each
group, repeated passages are cut out of the texts, and what is left is packed.

Every stage takes an empty table and gives an empty one, and keeps columns it does not know. Equal
rows are judged alike and stay as often as they came, unless a stage says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import langid, packing, quality, simhash, substring
from mailgraph.llm.common import ready, table
from mailgraph.llm.queries import tokenizer_path
from mailgraph.session import scratch_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure; one without a letter, or without a text, has none."""
    ready(spark)
    return langid.keep_sure(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands; a null text has no words."""
    ready(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shares four in five 5-word shingles.

    Rows that share an id are one document, and rows without an id stay. All texts without words
    are alike."""
    ready(spark)
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur anywhere else, equal rows included.

    A null text stays null; ``n_chars`` follows the text where words were cut out."""
    ready(spark)
    cut = substring.remove_repeats(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    n_chars = F.coalesce(changed, F.col("n_chars")).alias("n_chars")
    return cut.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a null text is one end token."""
    ready(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]

# zstandard, XXH64 and BPE are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are kept in the scratch folder."""
    docs = table(ready(spark), sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
