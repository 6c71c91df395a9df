"""Quality by compression: base counts per text, and bands of zstandard ratios.

The ratio is bytes by compressed bytes. Repetitive text compresses too well, noise too badly.
Short texts compress worse than long ones, so each length has limits of its own; the whole text
and every chunk of fixed size are held to the limits of their own lengths.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.llm.common import append_columns, texts_of, words

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
LEVEL, CHUNK = 3, 4096
# (bytes from, lowest ratio, highest ratio): prose of that length lies well inside.
BANDS = [
    (0, 0.5, 1.6), (64, 0.7, 1.9), (128, 0.9, 2.3), (256, 1.05, 2.6), (512, 1.2, 2.9),
    (1024, 1.3, 3.1), (2048, 1.4, 3.3), (4096, 1.45, 3.6), (8192, 1.5, 4.0), (16384, 1.5, 4.5),
    (65536, 1.5, 5.5),
]
# A text goes if chunks with more than this share of its bytes lie outside. A rest of a few bytes
# can never compress into its band, so chunks are weighed, not counted.
MAX_BAD_CHUNKS = 0.2

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
OUTPUT = f"{COUNTS}, base_failed boolean, ratio double, bad_chunks double, kept boolean"


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in tokens], dtype=np.int64)
    # Number the runs of 1, 2, .. words by what they hold; exact, no hashing.
    runs, size = codes, len(numbers)
    for length in range(2, window + 1):
        runs = runs[:-1] * len(numbers) + codes[length - 1 :]
        size *= len(numbers)
        if size > 2**62 // len(numbers) or length == window:
            values, runs = np.unique(runs, return_inverse=True)
            size = len(values)
    if size == n:
        return 0
    twice = np.bincount(runs)[runs] > 1
    edges = np.zeros(n + window, dtype=np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def limits(length: int) -> tuple[float, float]:
    at = bisect_right(BANDS, (length, float("inf"), float("inf"))) - 1
    return BANDS[at][1:]


def band_verdict(text: bytes, compressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their band, and whether it passes."""
    if not text:
        return 0.0, 0.0, False
    ratio = len(text) / len(compressor.compress(text))
    low, high = limits(len(text))
    bad = 0
    if len(text) > CHUNK:
        view = memoryview(text)
        for start in range(0, len(text), CHUNK):
            chunk = view[start : start + CHUNK]
            chunk_low, chunk_high = limits(len(chunk))
            chunk_ratio = len(chunk) / len(compressor.compress(chunk))
            if not chunk_low <= chunk_ratio <= chunk_high:
                bad += len(chunk)
    share = bad / len(text)
    return ratio, share, low <= ratio <= high and share <= MAX_BAD_CHUNKS


def assess(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the base counts, the ratios and the verdict ``kept``.

    A null or empty text has no words, fails the base rules and is not kept. Every row is judged
    by itself, so equal rows give equal results and an empty table an empty one; columns that
    are named like a result are replaced.
    """

    def judge(column):
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        rows = []
        for raw in texts_of(column):
            tokens = words(raw)
            n, repeats = len(tokens), repeated_words(tokens)
            symbols = len(raw) - len(raw.translate(None, SYMBOLS))
            chars = len(b"".join(tokens).decode("utf-8", "replace"))
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            ratio, share, passed = band_verdict(raw, compressor)
            rows.append(
                (n, chars, symbols, repeated_lines(raw), repeats, failed, ratio, share,
                 passed and not failed)
            )
        return [list(values) for values in zip(*rows)] if rows else [[]] * 9

    return append_columns(df, [text], OUTPUT, judge)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    whole = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return assess(whole, "_text").where("kept").select("_row.*")
