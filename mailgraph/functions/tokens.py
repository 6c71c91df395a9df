"""Tokens of a cleaned text: lower-case, letters only."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgraph.functions import fixed

# Blanks and the punctuation that always ends a token. Hyphens, slashes, apostrophes and inner
# periods stay inside a token, which then is not all letters and is left out.
_PARTS = re.compile(
    "[^ \t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000,:;@#$%&?!()\\[\\]{}<>\"«»“”‘’„]+"
)
_EDGES = "'`."
_ENDINGS = tuple(fixed.CONTRACTION_ENDINGS)
_SPLIT = {head + tail: (head, tail) for head, tail in fixed.SPLIT_WORDS}


def _odd_part(part: str) -> str:
    """A part without the edges at its end, one contracted ending and the edges at its start."""
    part = part.rstrip(_EDGES)
    for ending in _ENDINGS:
        if part.endswith(ending):
            part = part[: -len(ending)]
            break
    return part.lstrip(_EDGES)


def _tokens_of(text: str) -> list[str]:
    found = []
    for part in _PARTS.findall(text.lower()):
        if not part.isalpha():
            part = _odd_part(part)
            if not part.isalpha():
                continue
        if part in _SPLIT:
            found += _SPLIT[part]
        else:
            found.append(part)
    return found


def _tokens(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else _tokens_of(t) for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.string()))


def tokens(cleaned: Column) -> Column:
    return F.arrow_udf(_tokens, "array<string>")(cleaned)


def each_word(words: str) -> Column:
    """One row per token; filter ``word is not null`` afterwards.

    The outer form on purpose: a plain explode has its emptiness test pushed below the
    expression that makes the tokens, which then is computed twice.
    """
    return F.explode_outer(words).alias("word")


def without_stop_words(words: Column, stop_words: list[str]) -> Column:
    """Drop stop words, keeping order and repeats. For a list short enough to be a literal.

    The engine looks a word up in a hash set of the list.
    """
    if not stop_words:
        return words
    stops = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stops))
