"""Best-fit packing of token sequences by bin completion over lengths.

A document longer than a sequence is cut so that all pieces but the first are full; the first
piece, and every shorter document, is an item of 1 to ``capacity`` tokens. How many items have
which length is all that packing needs: ``capacity`` numbers, however many documents there are.
Best-fit decreasing gives the incumbent. Bin completion takes the largest length left, tries all
undominated ways to fill up its bin, least waste first, and cuts a branch whose waste already
excludes fewer bins than the incumbent; it ends where the incumbent meets the lower bound. The
plan, a list of fillings with a number of bins each, is then dealt out to the items by their
running number within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.llm.bpe import PRETOKENS, transducer
from mailgraph.llm.common import kept_in_worker
from mailgraph.operators.numbering import position_in_group
from mailgraph.session import settle

CAPACITY, END = 2048, 0
# Nodes of the search, at most: packing is NP-hard, and the incumbent is there from the start.
NODES = 2_000
_LONG = 2000
_LONG_RUNS = [blank * 500 for blank in (" ", "\n", "\t", "\r", "\xa0", "\u3000")]


class Tokens:
    """Ids of whole texts, as the ``tokenizers`` file gives them, by a compiled encoder of its
    merges. Very long runs without a blank go through the transducer's window instead, because
    the encoder's time grows with the square of a run's length."""

    def __init__(self, path: str):
        self._windowed = transducer(path)
        vocabulary = self._windowed.vocabulary
        self._encoding = tiktoken.Encoding(
            "bulk",
            pat_str=PRETOKENS.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"),
            mergeable_ranks=vocabulary.token_ids,
            special_tokens=vocabulary.added,
        )

    def encode(self, text: str) -> bytes:
        if len(text) > _LONG and (
            max(map(len, text.split(" "))) > _LONG or any(run in text for run in _LONG_RUNS)
        ):
            return self._windowed.encode(text)
        ids = self._encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return ids.astype("<u4", copy=False).tobytes()


def pieces(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """(_key, piece, start, length, ids_crc32) of every document, END appended to its ids.

    A null text is empty; a null key stays null; equal rows are cut as often as they come; an empty
    table gives an empty one. A very long text is held whole, with its ids, by one task. Other
    columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker(f"tokens {path}", lambda: Tokens(path))
        end = END.to_bytes(4, "little")
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for row, value in enumerate(texts):
                ids = memoryview(tokens.encode(value) + end)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((row, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            at, number, start, length, crc = (np.array(c) for c in zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["_key", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(
        cut, f"_key {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing over a histogram, [(bins, items), ...].

    Items of one length fill the fullest bin that can take one until it can take no more, so all
    bins of equal room and content are handled as one entry.
    """
    # By room left: {items: bins}. A bin of no room takes part no more.
    rooms: dict[int, dict[tuple, int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in rooms if r >= length):
            each = room // length
            for items, bins in list(rooms[room].items()):
                if not left:
                    break
                for n, taken in ((each, min(bins, left // each)), (left % each, 1)):
                    if n and taken and rooms[room].get(items, 0) >= taken and left >= n * taken:
                        rooms[room][items] -= taken
                        if not rooms[room][items]:
                            del rooms[room][items]
                        grown = rooms.setdefault(room - n * length, {})
                        key = items + (length,) * n
                        grown[key] = grown.get(key, 0) + taken
                        left -= n * taken
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        each = capacity // length
        for n, bins in ((each, left // each), (left % each, 1)):
            if n and bins and left >= n * bins:
                opened = rooms.setdefault(capacity - n * length, {})
                key = (length,) * n
                opened[key] = opened.get(key, 0) + bins
                left -= n * bins
    return [(bins, items) for room in sorted(rooms) for items, bins in rooms[room].items()]


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: for each limit, items over half a bin stand alone, those that
    leave less than the limit are full, and the others of at least the limit share what is left."""
    lengths = sorted(histogram)
    number, tokens = [0], [0]
    for one in lengths:
        number.append(number[-1] + histogram[one])
        tokens.append(tokens[-1] + one * histogram[one])
    half = bisect_right(lengths, capacity // 2)
    best = -(-tokens[-1] // capacity)
    for limit in [1, *(one for one in lengths if 2 * one <= capacity)]:
        full = bisect_right(lengths, capacity - limit)
        small = bisect_left(lengths, limit)
        alone, large = number[-1] - number[full], number[full] - number[half]
        room = large * capacity - (tokens[full] - tokens[half])
        rest = max(0, tokens[half] - tokens[small] - room)
        best = max(best, alone + large + -(-rest // capacity))
    return best


def _spread(bits: int, width: int) -> int:
    """Bits at 0 to ``width`` places above each set bit."""
    done = 1
    while done <= width:
        step = min(done, width + 1 - done)
        bits |= bits << step
        done += step
    return bits


def fillings(rest: int, counts: dict[int, int], most_waste: int) -> Iterator[tuple]:
    """Every undominated way to fill ``rest`` tokens with at most ``most_waste`` to spare.

    Least waste first; of equal waste those with the larger items first. A filling is dominated
    if another item still fits, or if some of its items (one, or several together) can be replaced
    by an item left that is at least as large and fits: whatever the filling leads to, the other
    does with no more bins. Sums that the items can make are bits of whole numbers, so no choice that
    misses the wanted sum is followed.
    """
    lengths = sorted(one for one in counts if one <= rest)
    mask = (1 << (rest + 1)) - 1
    reach = [1]  # sums of the first n lengths, as often as there are items of them
    for one in lengths:
        bits, copies = reach[-1], min(counts[one], rest // one)
        step = 1
        while copies:
            step = min(step, copies)
            bits |= (bits << (step * one)) & mask
            copies -= step
            step *= 2
        reach.append(bits)
    free = sum(1 << one for one in lengths)

    def without(chosen: tuple) -> int:
        """Lengths of which an item is left besides those chosen."""
        out = free
        for one in set(chosen):
            if chosen.count(one) >= counts[one]:
                out &= ~(1 << one)
        return out

    def replaceable(chosen: tuple, waste: int) -> bool:
        single, several = 0, 0  # sums of one and of more chosen items
        for one in chosen:
            several |= (several << one) | (single << one)
            single |= 1 << one
        left = without(chosen)
        # A larger item in place of one or none, or one at least as large in place of several.
        larger = _spread(single << 1 | 2, waste - 1) if waste else 0
        return bool((larger | _spread(several, waste)) & left)

    def exact(total: int, top: int, chosen: tuple) -> Iterator[tuple]:
        if not total:
            yield chosen
            return
        for at in range(min(top, bisect_right(lengths, total)), 0, -1):
            one = lengths[at - 1]
            for copies in range(min(counts[one], total // one), 0, -1):
                after = total - copies * one
                if reach[at - 1] >> after & 1:
                    grown = chosen + (one,) * copies
                    # What is dominated without any waste stays so whatever is added.
                    if not replaceable(grown, 0):
                        yield from exact(after, at - 1, grown)

    for waste in range(min(rest, most_waste) + 1):
        if reach[-1] >> (rest - waste) & 1:
            for found in exact(rest - waste, len(lengths), ()):
                if not waste or not replaceable(found, waste):
                    yield found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple]:
    """Fillings and their numbers of bins, [(bins, (length, ...)), ...], for all items.

    Best-fit decreasing is the first incumbent, so the plan is never worse. A branch completes the
    bin of the largest item left with each undominated filling, as often as the items allow or
    once, and ends where its waste leaves no room for fewer bins than the incumbent's.
    """
    return search(histogram, capacity, nodes)[0]


def search(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple], int]:
    """The plan, and the nodes it took.

    One table of what is left serves all depths: steps are undone on the way back. Only the
    deepest frame holds an enumeration; one that is come back to enumerates anew up to its place.
    """
    incumbent = best_fit(histogram, capacity)
    best = sum(bins for bins, _ in incumbent)
    total = sum(length * n for length, n in histogram.items())
    lower = lower_bound(histogram, capacity)
    counts, bins, waste, spent = dict(histogram), 0, 0, 0

    def children(tried: int) -> Iterator[tuple]:
        """(place, times, items) from place ``tried`` on; each filling has two places."""
        left, before = dict(counts), waste
        largest = max(left)
        others = {one: n - (one == largest) for one, n in left.items() if n > (one == largest)}
        for n, filling in enumerate(fillings(capacity - largest, others, (best - 1) * capacity - total - before)):
            items = (largest, *filling)
            uses = Counter(items)
            lost = capacity - sum(items)
            room = (best - 1) * capacity - total - before
            most = min(left[one] // k for one, k in uses.items())
            if lost:
                most = min(most, max(1, room // lost))
            for place, times in ((2 * n, most), (2 * n + 1, 1)):
                if place >= tried and times * lost <= room and (place % 2 == 0 or most > 1):
                    yield place, times, items

    def change(step: tuple, sign: int) -> None:
        nonlocal bins, waste
        times, items = step
        bins += sign * times
        waste += sign * times * (capacity - sum(items))
        for one, n in Counter(items).items():
            counts[one] = counts.get(one, 0) - sign * n * times
            if not counts[one]:
                del counts[one]

    # A frame: its enumeration, the next place in it, the step taken from it.
    frames: list[list] = [[None, 0, None]] if histogram else []
    while frames and best > lower and spent < nodes:
        frame = frames[-1]
        if frame[2]:
            change(frame[2], -1)
            frame[2] = None
        frame[0] = frame[0] or children(frame[1])
        child = next(frame[0], None)
        if child is None:
            frames.pop()
            continue
        spent += 1
        frame[1], frame[2] = child[0] + 1, child[1:]
        change(frame[2], 1)
        if not counts:
            if bins < best:
                best, incumbent = bins, [step for _, _, step in frames]
        elif bins + lower_bound(counts, capacity) < best:
            frame[0] = None
            frames.append([None, 0, None])
    return incumbent, spent


def slots(steps: list[tuple]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first running number of each slot group, its first sequence, items of that
    length in each bin, and the offset of the first of them. They are neighbours in the bin."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, items in steps:
        offset = 0
        for one in dict.fromkeys(items):
            n = items.count(one)
            by_length.setdefault(one, []).append((used.get(one, 0), sequence, n, offset))
            used[one] = used.get(one, 0) + n * times
            offset += n * one
        sequence += times
    return {one: tuple(map(np.array, zip(*rows))) for one, rows in by_length.items()}


def pack(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns (key, piece, start, length, ids_crc32, sequence_id, offset) for every piece. Null
    and empty texts have the end token alone. Equal rows are packed as often as they come; an
    empty table gives an empty one. Other columns are not read.
    """
    cut = settle(pieces(df, path, key, text, capacity))
    # At most one row for each length.
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    groups = slots(plan(counts, capacity))
    order = ["_key", "piece", "start", "ids_crc32"]
    numbered = position_in_group(cut, ["length"], order, "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() - 1
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                since, first, each, begin = groups[int(one)]
                at = np.searchsorted(since, number[mine], side="right") - 1
                inside = number[mine] - since[at]
                sequence[mine] = first[at] + inside // each[at]
                offset[mine] = begin[at] + inside % each[at] * one
            columns = [batch.column(c) for c in ("_key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = df.schema[key].dataType.simpleString()
    return numbered.mapInArrow(
        place,
        f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long,"
        " offset long",
    )
