"""Repeated passages from groups of equal prefixes, at two prefix lengths; no tree is built.

Two depths of a suffix tree over words would tell the same: which runs of PREFIX words and which
runs of WINDOW words occur twice. Only these two are looked at, and the first only at anchors: in
every window the run of PREFIX words with the smallest hash is its anchor, so equal windows have
equal anchors; windows around an anchor that occurs once are dropped. The prefixes of the windows
left are lengthened to WINDOW words, and one that occurs twice is a repeat. Runs are compared by
their hashes (64 bits for anchors, 128 for windows); runs of covered words are the maximal repeats.

Documents are dealt into chunks by their row number and never leave them. A chunk sorts its own
prefixes and sends each distinct one once to the group that its hash names, and gets back one bit
for each. So a passage that a third of all documents share costs a group one entry for each chunk,
whatever its number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgraph.llm.common import kept_in_worker, texts_of, words

WINDOW, PREFIX = 35, 8
# Bytes of text in a chunk, and chunks to a group of prefixes, on average.
CHUNK_BYTES, CHUNKS_PER_GROUP = 2 << 20, 6
MEMO_WORDS = 300_000
_ANCHORS, _WINDOWS = 1, 2
_LAST = np.uint64(2**64 - 1)
# Odd multipliers for the two window hashes.
_FIRST, _SECOND = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Codes(dict):
    """64-bit codes of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def _joined(left: np.ndarray, right: np.ndarray, factors: tuple[int, int]) -> np.ndarray:
    """Hash of two neighbouring runs from their hashes."""
    out = left * np.uint64(factors[0]) + (right ^ (right >> np.uint64(29))) * np.uint64(factors[1])
    return out ^ (out >> np.uint64(32))


def _runs(codes: np.ndarray, length: int, factors: tuple[int, int]) -> np.ndarray:
    """Hashes of all runs of ``length`` words: doubled up, then two overlapping halves."""
    hashes, size = codes, 1
    while 2 * size <= length:
        hashes = _joined(hashes[:-size], hashes[size:], factors)
        size *= 2
    return hashes if size == length else _joined(
        hashes[: len(codes) - length + 1], hashes[length - size :], factors
    )


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over all runs of ``width`` values."""
    best, size = values, 1
    while 2 * size <= width:
        best = pick(best[:-size], best[size:])
        size *= 2
    return best if size == width else pick(
        best[: len(values) - width + 1], best[width - size :]
    )


class Chunk:
    """Words of the documents of a chunk, one after the other, and their prefixes."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, prefix: int = PREFIX):
        self.window, self.prefix = window, prefix
        memo = kept_in_worker("word codes", _Codes)
        self.words = [words(text) for text in texts]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        total = int(self.lengths.sum())
        codes = (memo[w] for document in self.words for w in document)
        self.codes = np.fromiter(codes, np.uint64, total)
        # Words from here to the end of the document.
        ends = np.cumsum(self.lengths)
        self.left = np.repeat(ends, self.lengths) - np.arange(total)
        self.anchors = self.anchor_counts = np.array([], np.uint64)
        self.starts = np.array([], np.int64)
        if total >= window:
            self._find_anchors(total - window + 1)

    def _find_anchors(self, n: int) -> None:
        prefix, wide = self.prefix, self.window - self.prefix + 1
        runs = _runs(self.codes, prefix, _FIRST)
        runs = np.where(self.left[: len(runs)] >= prefix, runs, _LAST)
        least = _sliding(runs, wide, np.minimum)
        inside = self.left[:n] >= self.window
        # A run is an anchor if it is the smallest of one of the windows around it.
        around = np.zeros(n + 2 * (wide - 1), np.uint64)
        around[wide - 1 : wide - 1 + n] = np.where(inside, least, 0)
        chosen = _sliding(around, wide, np.maximum) == runs
        self.anchors, self.anchor_counts = np.unique(runs[chosen], return_counts=True)
        self.starts = np.flatnonzero(inside)
        self.least = least[self.starts]

    def keep_windows(self, repeated: np.ndarray) -> None:
        """Hash the windows whose anchor is one of the ``repeated`` (sorted)."""
        if not len(repeated) or not len(self.starts):
            self.starts = self.starts[:0]
        else:
            at = np.minimum(np.searchsorted(repeated, self.least), len(repeated) - 1)
            self.starts = self.starts[repeated[at] == self.least]
        self.hashes = np.zeros(len(self.starts), "<u8,<u8")
        for name, factors in (("f0", _FIRST), ("f1", _SECOND)):
            if len(self.starts):
                self.hashes[name] = _runs(self.codes, self.window, factors)[self.starts]
        order = np.lexsort((self.hashes["f1"], self.hashes["f0"]))
        sorted_hashes = self.hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
        self.distinct = sorted_hashes[new]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.place, minlength=len(self.distinct))

    def covered(self, repeated: np.ndarray) -> list[np.ndarray]:
        """Per document, which words lie in a repeated window; ``repeated`` is by distinct window."""
        edges = np.zeros(len(self.codes) + 1, np.int64)
        starts = self.starts[repeated[self.place]] if len(self.starts) else self.starts
        edges[starts] += 1
        np.subtract.at(edges, starts + self.window, 1)
        return np.split(np.cumsum(edges[:-1]) > 0, np.cumsum(self.lengths)[:-1])


def _group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    low = hashes["f0"] if hashes.dtype.names else hashes
    return ((low ^ (low >> np.uint64(31))) % np.uint64(groups)).astype(np.int64)


def _sent(level: int, chunk: int, hashes: np.ndarray, groups: int) -> pa.Table:
    """One row for each group with the chunk's sorted prefixes that belong there."""
    of = _group_of(hashes, groups)
    order = np.argsort(of, kind="stable")
    numbers, starts = np.unique(of[order], return_index=True)
    parts = np.split(hashes[order], starts[1:]) if len(numbers) else []
    return pa.table(
        {
            "_group": pa.array(numbers, pa.int64()),
            "_level": pa.array([level] * len(numbers), pa.int32()),
            "_chunk": pa.array([chunk] * len(numbers), pa.int64()),
            "_data": pa.array([p.tobytes() for p in parts], pa.binary()),
        }
    )


def _answers(rows: pa.Table, level: int, hashes: np.ndarray, groups: int) -> np.ndarray:
    """Which of the chunk's prefixes the groups have found in other chunks."""
    of = _group_of(hashes, groups)
    order = np.argsort(of, kind="stable")
    found = np.zeros(len(hashes), bool)
    numbers, starts = np.unique(of[order], return_index=True)
    place = {int(g): (a, b) for g, a, b in zip(numbers, starts, [*starts[1:], len(hashes)])}
    for row in rows.to_pylist():
        if row["_level"] == level:
            a, b = place[row["_group"]]
            bits = np.unpackbits(np.frombuffer(row["_data"], np.uint8), count=b - a)
            found[order[a:b]] = bits.astype(bool)
    return found


def _repeats(table: pa.Table) -> pa.Table:
    """A bit for each prefix of a group that two chunks have sent."""
    level = table["_level"][0].as_py()
    kind = "<u8" if level == _ANCHORS else "<u8,<u8"
    parts = [np.frombuffer(data, kind) for data in table["_data"].to_pylist()]
    every = np.concatenate(parts)
    order = np.lexsort((every["f1"], every["f0"])) if every.dtype.names else np.argsort(every)
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    bits = np.split(twice, cuts)
    some = [n for n, b in enumerate(bits) if b.any()]
    rows = table.select(["_group", "_level", "_chunk"]).take(pa.array(some, pa.int64()))
    return rows.append_column("_data", pa.array([np.packbits(bits[n]).tobytes() for n in some], pa.binary()))


_SENT = "_group long, _level int, _chunk long, _data binary"


def _chunk_of(table: pa.Table, window: int, prefix: int) -> Chunk:
    column = table["_words_of"].combine_chunks()
    return Chunk(texts_of(column), window, prefix)


def remove_repeats(
    df: DataFrame, text: str = "text", window: int = WINDOW, prefix: int = PREFIX
) -> DataFrame:
    """Remove every word inside a run of ``window`` words that occurs anywhere else, too.

    Returns all rows and columns; ``text`` is replaced by the words left, joined by one blank,
    if any was removed, and appended are ``n_words``, ``n_removed``, ``spans`` (from, to: the
    maximal runs removed, in words) and ``kept_words`` (the words left, joined by one blank).
    All runs are judged on the input. A null text has no words; texts shorter than the window
    keep all. Rows that are equal are repeats of each other, and are dealt out like others; an
    empty table gives an empty one. Columns of ``df`` that are named like an appended one, or
    ``_row``, are replaced. ``df`` should be a stored table: row numbers follow its files, so that
    a task that is run again deals its rows into the same chunks.
    """
    df = df.withColumn("_row", F.monotonically_increasing_id())
    appended = "n_words long, n_removed long, spans array<struct<from:int,to:int>>, kept_words string"
    new = T._parse_datatype_string(appended)
    names = [c for c in df.columns if c not in new.names and c != "_row"]
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    groups = max(16, -(-chunks // CHUNKS_PER_GROUP))
    dealt = df.select(
        *names,
        F.col(text).alias("_words_of"),
        F.pmod(F.xxhash64("_row"), F.lit(chunks)).alias("_chunk"),
    ).drop(text)

    def anchors(key, table):
        chunk = _chunk_of(table, window, prefix)
        return _sent(_ANCHORS, key[0].as_py(), chunk.anchors, groups)

    def windowed(table, rows) -> Chunk:
        chunk = _chunk_of(table, window, prefix)
        found = _answers(rows, _ANCHORS, chunk.anchors, groups)
        chunk.keep_windows(chunk.anchors[found | (chunk.anchor_counts > 1)])
        return chunk

    def windows(key, table, rows):
        if not len(table):
            return _sent(_WINDOWS, 0, np.array([], "<u8,<u8"), groups)
        return _sent(_WINDOWS, key[0].as_py(), windowed(table, rows).distinct, groups)

    def group(table):
        return _repeats(table)

    kept = [c for c in names if c != text]
    schema = T.StructType([df.schema[c] for c in names] + new.fields)

    def cut(key, table, rows):
        chunk = windowed(table, rows)
        found = _answers(rows, _WINDOWS, chunk.distinct, groups) | (chunk.counts > 1)
        left, removed, spans = [], [], []
        for document, gone in zip(chunk.words, chunk.covered(found)):
            count = int(gone.sum())
            removed.append(count)
            if count:
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans.append([{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()])
                document = [word for word, is_gone in zip(document, gone.tolist()) if not is_gone]
            else:
                spans.append([])
            left.append(b" ".join(document))
        words_left = pa.array(left, pa.binary()).cast(pa.string())
        untouched = pa.array([n == 0 for n in removed], pa.bool_())
        columns = {c: table[c].combine_chunks() for c in kept}
        columns[text] = pa.compute.if_else(
            untouched, table["_words_of"].combine_chunks(), words_left
        )
        columns |= {
            "n_words": pa.array(chunk.lengths, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
            "kept_words": words_left,
        }
        return pa.table({c: columns[c] for c in schema.names})

    by_chunk = dealt.groupBy("_chunk")
    short = by_chunk.applyInArrow(anchors, _SENT).groupBy("_group").applyInArrow(group, _SENT)
    longer = by_chunk.cogroup(short.groupBy("_chunk")).applyInArrow(windows, _SENT)
    longer = longer.groupBy("_group").applyInArrow(group, _SENT)
    both = short.union(longer)
    return by_chunk.cogroup(both.groupBy("_chunk")).applyInArrow(cut, schema)

