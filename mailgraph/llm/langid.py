"""Language by compression: the language whose dictionary makes the text smallest.

Each language has a raw-content zstandard dictionary made of some of its labelled texts. A text
is folded (letters in lower case, all else one blank), cut into blocks that are small against
the dictionary, and encoded with every dictionary.
"""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.llm.common import append_columns

# Bounds of the fitting sample: texts for each language, languages, bytes of a dictionary.
SAMPLE_ROWS, MAX_LANGUAGES, DICTIONARY_BYTES = 96, 256, 65536
SAMPLE_BYTES = (200, 8192)  # texts of this size are taken first
LEVEL, BLOCK = 6, 2048
# A prediction whose second best is less than this share larger is too narrow.
NARROW = 0.01
# Bytes of lead that make one language e times as likely as another.
SCALE = 3.0
UNKNOWN = "und"

_OTHER = regex.compile(r"\P{L}+")


def fold(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Dictionaries by language from at most SAMPLE_ROWS texts each, chosen by a hash.

    Of rows that share language and id one is learned from: the one of ordinary size with the
    least digest, else of any size. So at most one text, cut to DICTIONARY_BYTES, for each place
    reaches the driver: all bounded by the parameters above, whatever the rows. Rows without
    language or text are not learned from; a null id is an id like others. An empty table gives no
    dictionary.
    """
    length = F.octet_length(F.col(text))
    rows = df.where(F.col(lang).isNotNull() & (length > 0)).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(lang).alias("lang"),
        F.col(text).alias("text"), (~length.between(*SAMPLE_BYTES)).alias("odd"),
    )
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    counts = {row["lang"]: row["count"] for row in common.collect()}
    digest = F.md5(F.col("text").cast("binary"))
    one = rows.groupBy("lang", "id").agg(F.min(F.struct("odd", digest.alias("digest"))).alias("one"))
    order = Window.partitionBy("lang").orderBy("one.odd", F.xxhash64("id"), "id")
    chosen = (
        one.where(F.col("lang").isin(list(counts)))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE_ROWS)
        .select("lang", "id", F.col("one.digest").alias("digest"), "place")
    )
    # At most SAMPLE_ROWS * MAX_LANGUAGES places, so the list goes to every task.
    found = rows.withColumn("digest", digest).join(F.broadcast(chosen), ["lang", "id", "digest"])
    texts = found.groupBy("lang", "place").agg(F.first(F.left("text", F.lit(DICTIONARY_BYTES))).alias("text"))
    sample: dict[str, dict[int, str]] = {}
    for name, place, value in texts.collect():
        sample.setdefault(name, {})[place] = value
    model = {}
    for name in sorted(sample, key=lambda name: (-counts[name], name)):
        folded = " ".join(fold(sample[name][place]) for place in sorted(sample[name])).encode()
        if folded:
            model[name] = folded[:DICTIONARY_BYTES]
    return model


def compressors(model: dict[str, bytes]) -> dict:
    made = {}
    for name, content in model.items():
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made[name] = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False,
            write_dict_id=False,
        )
    return made


def classify(text: str | None, encoders: dict) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected). Ties go to the language with more learned texts."""
    folded = fold(text or "")
    if not encoders or not folded:
        return UNKNOWN, 0.0, 0.0, True
    data = memoryview(f" {folded} ".encode())
    blocks = [data[n : n + BLOCK] for n in range(0, len(data), BLOCK)]
    sizes = {name: sum(len(e.compress(b)) for b in blocks) for name, e in encoders.items()}
    best, *others = sorted(sizes, key=sizes.get)
    least = sizes[best]
    margin = (sizes[others[0]] - least) / sizes[others[0]] if others else 1.0
    score = 1 / sum(math.exp((least - size) / SCALE) for size in sizes.values())
    return best, score, margin, margin < NARROW


def predict(df: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score``, ``margin`` and ``rejected`` for every whole text.

    Null texts and texts without a letter are ``und``, with score 0, and rejected; so is all if
    nothing was learned. Rows are judged by themselves; equal texts give equal results, an empty
    table an empty one. Columns that are named like a result are replaced.
    """

    def judge(column):
        encoders = compressors(model)
        rows = [classify(value, encoders) for value in column.to_pylist()]
        return [list(values) for values in zip(*rows)] if rows else [[]] * 4

    outputs = "lang_pred string, score double, margin double, rejected boolean"
    return append_columns(df, [text], outputs, judge)


def keep_sure(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows whose language is sure, with the columns they came with."""
    model = learn(df.where(~held_out(F.col(key))), key, text, lang)
    whole = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return predict(whole, model, "_text").where("NOT rejected").select("_row.*")
