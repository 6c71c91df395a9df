"""Body text: cleaning and counting."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgraph.functions import fixed

# A character that is a digit or no word character, with Python's Unicode meaning of both:
# letters, other numbers and the underscore are word characters, decimal digits are digits.
DIGIT_OR_NON_WORD = r"[^\p{L}\p{Nl}\p{No}_]"
WORD = r"[\p{L}\p{N}_]+"

# From the first opening of a line to the line's last end; looked for once in each line.
COMMENT = r"(?<![^\n])(?:(?!<!-)[^\n])*+(<!--?[^\n]*-->)"
WEB_ADDRESS = r"\b(?:[a-z]+://|www\.)\S+"


TAG = "<[^>]*>"


_PLAIN = re.compile(r"[\w ,:=-]*", re.ASCII)
# Of a run of slash pairs only the last pair counts as the hit. In Python \W and \d are the
# characters of DIGIT_OR_NON_WORD.
_SLASH_PAIRS = re.compile(r"(?:/[\W\d])*(/[\W\d])")
_COMMENT = re.compile(COMMENT)
_ADDRESS = re.compile(r"[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
_ADDRESS_AT_START = re.compile(r"(?<![a-zA-Z0-9._%+-])" + _ADDRESS.pattern)


def _marker(marker: str) -> Callable[[str], int]:
    """The place of the first hit of a marker, -1 without one; dashes before it belong to it."""
    dashes = marker.startswith("-*")
    word = marker.removeprefix("-*") if dashes else marker
    literal = word.partition("(?!")[0]
    if not _PLAIN.fullmatch(literal):
        pattern = re.compile(marker.replace("-*", "(?<!-)-*+", 1))
        return lambda text: m.start() if (m := pattern.search(text)) else -1
    pattern = re.compile(word)

    def place(text: str) -> int:
        at = text.find(literal)
        if at >= 0 and literal != word:
            found = pattern.search(text, at)
            at = found.start() if found else -1
        if dashes and at > 0:
            at = len(text[:at].rstrip("-"))
        return at

    return place


def _cutter(markers: list[str]) -> Callable[[str], str]:
    """Deletes everything from the first hit of any marker to the end.

    A tag is cut first: if the first `<` has no `>` after it, no other has.
    """
    places = [_marker(m) for m in markers if m != TAG]

    def cut(text: str) -> str:
        if TAG in markers and (at := text.find("<")) >= 0 and text.find(">", at) >= 0:
            text = text[:at]
        # A marker that starts before the first hit so far may end behind it.
        return text[: min((at for place in places if (at := place(text)) >= 0), default=len(text))]

    return cut


def _addresses(text: str) -> list[str]:
    """Mail addresses, each looked for where a run of address characters or the rest of one starts."""
    hits, at = [], 0
    while found := _ADDRESS.match(text, at) or _ADDRESS_AT_START.search(text, at):
        hits.append(found.group())
        at = found.end()
    return hits


def _without(text: str, hits: list[str]) -> str:
    for hit in hits:
        text = text.replace(hit, "")
    return text


def _on_texts(change: Callable[[str], str]):
    """A column function that changes each text; null stays null."""

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")


def _typed(owner: str) -> Callable[[str], str]:
    first = _cutter([*fixed.CUTS_BEFORE_SLASHES, fixed.NOTICE_OPENING + owner])
    second = _cutter(fixed.CUTS_BEFORE_ADDRESSES)

    def typed(text: str) -> str:
        x = first(text.replace("*", "").replace("_", ""))
        if "/" in x:
            x = _without(x, _SLASH_PAIRS.findall(x))
        if "<!-" in x:
            x = _without(x, _COMMENT.findall(x))
        x = second(x)
        return _without(x, _addresses(x)) if "@" in x else x

    return typed


def clean_body(text: Column, owner: str = fixed.NOTICE_OWNER, strip_urls: bool = False) -> Column:
    """Body clean-up of the mail tables: keep what the writer typed, drop quotes and footers.

    Plain string searches in Python: a chain of patterns takes some 25 times as long.
    """
    typed, last = _typed(owner), _cutter(fixed.CUTS_LAST)
    if not strip_urls:
        return _on_texts(lambda x: last(typed(x)))(text)
    return _on_texts(last)(F.regexp_replace(_on_texts(typed)(text), WEB_ADDRESS, ""))


def clean_export_body(text: Column, drop_underscore: bool = False) -> Column:
    """Body clean-up of the exports: lower case, words separated by single blanks."""
    x = F.translate(F.lower(text), "\t*_" if drop_underscore else "\t*", "")
    x = F.regexp_replace(x, r"<!--?[^\n]*?-->", " ")
    return F.regexp_replace(x, f"{DIGIT_OR_NON_WORD}+", " ")


def export_body(text: Column, drop_underscore: bool = False) -> Column:
    """Cleaned body, or the word ``Null`` for a mail without one."""
    return F.when(text != "", clean_export_body(text, drop_underscore)).otherwise("Null")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")
