"""Byte-level BPE as a streaming transducer, and its way back.

The merge list decides how far a later byte can change an earlier token. Two runs of the merges,
on ``w`` and on ``w + x``, agree up to a front that starts at the end of ``w``. A rule ``(u, v)``
moves the front only if ``u`` ends there and ``v`` begins there in one run, and then by ``u``;
a later rule moves it on only if its ``v`` begins with that ``u``. The heaviest such chain of
rules, found in one walk over the list, is the sufficient lookahead: tokens that end that far
before the end of the window are final. So a piece of any length is encoded through a window of
fixed size, and its state is the unfinished end of that window.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from mailgraph.llm.common import append_columns, kept_in_worker

# Fixed value: how byte-level BPE cuts text before merging.
PRETOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A blank or line end inside a run of white space, or at the end: not a safe place to cut.
_UNSAFE_CUT = regex.compile(r"\p{White_Space}[ \n](?:\p{White_Space}|\Z)")
# Bytes taken into the window at a time; results do not depend on it.
STEP = 2048
# Remembered pieces of text at most, and the longest one remembered.
MEMO_PIECES, MEMO_LENGTH = 200_000, 64
_BLOCK = 1 << 16


def byte_names() -> dict[str, int]:
    """The printable names that vocabulary files give the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """Bytes of all tokens of a byte-level BPE file, added ones as their text."""
    names = byte_names()
    found = {i: bytes(names[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    return found | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class Vocabulary:
    """Merges, token bytes and added tokens of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        spec = read_spec(path)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = token_bytes(spec)
        self.byte_ids = [0] * 256
        for i, token in self.bytes_of.items():
            if len(token) == 1 and i not in self.added.values():
                self.byte_ids[token[0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # (left, right) -> (rank, merged)
        self.rules = {
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)
        }
        self.rank = {i: -1 for i in self.bytes_of} | {m: r for r, m in self.rules.values()}
        self.parts = {merged: pair for pair, (_, merged) in self.rules.items()}
        self.lookahead = self._sufficient_lookahead()
        # Tokens that the merges can make; rules come after the rules that make their parts.
        made = set(self.byte_ids)
        for (u, v), (rank, merged) in self.rules.items():
            if u in made and v in made and self.neighbours(u, v, rank):
                made.add(merged)
        self.token_ids = {self.bytes_of[i]: i for i in made}
        # Length of the longest token that begins with four given bytes.
        self.longest: dict[bytes, int] = {}
        for token in self.token_ids:
            if len(token) > 3:
                self.longest[token[:4]] = max(self.longest.get(token[:4], 0), len(token))

    def neighbours(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether the merges before rank ``limit`` leave ``left`` and ``right`` side by side.

        Walks back through the merges that made the two tokens, latest first. At each step the
        two parts that meet must not have a rule that would have been applied before either was
        taken up; of equal rules the one further left goes first.
        """
        rules, rank, parts = self.rules, self.rank, self.parts
        while True:
            rule = rules.get((left, right))
            if rule is not None and rule[0] < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, left = a, parts[left][1]
            elif b >= 0:
                limit, right = b + 1, parts[right][0]
            else:
                return True

    def _sufficient_lookahead(self) -> int:
        reach: dict[int, int] = {}  # token u -> bytes the front may have moved when u was merged
        first: dict[int, int] = {}  # merged token -> its left part
        longest = 0
        for (u, v), (_, merged) in self.rules.items():
            before, part = 0, v
            while part is not None:
                before = max(before, reach.get(part, 0))
                part = first.get(part)
            moved = len(self.bytes_of[u]) + before
            reach[u] = max(reach.get(u, 0), moved)
            first.setdefault(merged, u)
            longest = max(longest, moved)
        return longest


class Transducer:
    """Text to token ids, piece by piece."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP):
        self.vocabulary = vocabulary
        self.step = step
        self._pretokens = regex.compile(PRETOKENS)
        self._added = None
        if vocabulary.added:
            longest_first = sorted(vocabulary.added, key=len, reverse=True)
            self._added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        self._fits: dict[tuple[int, int], bool] = {}
        self._words = _Memo(self._word)
        self._memo = _Memo(self._piece)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if self._added is None or not self._added.search(text):
            return b"".join(self._plain(text))
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        """The same ids, bit by bit."""
        for part in self._added.split(text) if self._added else [text]:
            if part in self.vocabulary.added:
                yield packed([self.vocabulary.added[part]])
            else:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[bytes]:
        cut = self.cut(text)
        if cut is None:
            return (self._words[match.group()] for match in self._pretokens.finditer(text))
        return map(self._memo.__getitem__, cut)

    def cut(self, text: str) -> list[str] | None:
        """Pieces that are encoded alone; None where white space stands so that it needs a look."""
        if not text:
            return []
        if "\0" in text or _UNSAFE_CUT.search(text):
            return None
        # White space starts a pretoken here, so the text falls apart at it.
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _piece(self, text: str) -> bytes:
        """Ids of a text between two safe cuts."""
        if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):
            return self._word(text)
        return b"".join(map(self._words.__getitem__, self._pretokens.findall(text)))

    def _word(self, text: str) -> bytes:
        data = text.encode()
        if len(data) <= self.step:
            return packed(self._segmented(data))
        return b"".join(map(packed, self.pretoken(data)))

    def pretoken(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one pretoken as they become final."""
        lengths = self.vocabulary.bytes_of
        window = self.step + self.vocabulary.lookahead
        start = 0
        while len(data) - start > window:
            ids = self._segmented(data[start : start + window])
            end, final = 0, []
            for i in ids:
                end += len(lengths[i])
                if end > self.step:
                    break
                final.append(i)
                start_next = end
            if not final:  # one token as long as the step: take a larger window
                window *= 2
                continue
            yield final
            start += start_next
        yield self._segmented(data[start:])

    def _segmented(self, data: bytes) -> list[int]:
        """Tokens of ``data``.

        A sequence of tokens is what the merges give exactly if every two neighbours are, so the
        tokens are found from left to right, longest first. A place that was reached and led
        nowhere is no token boundary and is not tried again: the way to it was the only one.
        """
        vocabulary, fits = self.vocabulary, self._fits
        token_ids, longest = vocabulary.token_ids.get, vocabulary.longest.get
        end = len(data)
        ids: list[int] = []
        places = [0]
        dead: set[int] = set()
        at, to = 0, min(end, longest(data[:4], 3))
        while at < end:
            last = ids[-1] if ids else -1
            while to > at:
                token = token_ids(data[at:to])
                if token is not None and not (dead and to in dead):
                    if last < 0:
                        break
                    pair = (last, token)
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) >= MEMO_PIECES:
                            fits.clear()
                        fit = fits[pair] = vocabulary.neighbours(last, token)
                    if fit:
                        break
                to -= 1
            if to > at:
                ids.append(token)
                at = to
                places.append(at)
                to = min(end, at + longest(data[at : at + 4], 3))
            else:
                dead.add(at)
                ids.pop()
                places.pop()
                to, at = at - 1, places[-1]
        return ids


class _Memo(dict):
    """Ids of pieces met before; it starts anew when full, so its memory is bounded."""

    def __init__(self, encode: Callable[[str], bytes]):
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class ByteDecoder:
    """Token ids to text; the state is the unfinished character at the end of what came so far."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self._bytes_of = bytes_of
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        bytes_of = self._bytes_of
        try:
            data = b"".join(map(bytes_of.__getitem__, ids))
        except KeyError:  # ids outside the vocabulary stand for nothing
            data = b"".join(bytes_of.get(i, b"") for i in ids)
        return self._state.decode(data)

    def finish(self) -> str:
        rest = self._state.decode(b"", True)
        self._state.reset()
        return rest

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, in blocks."""
        view = memoryview(ids).cast("I")
        parts = [self.feed(view[n : n + _BLOCK]) for n in range(0, len(view), _BLOCK)]
        return "".join(parts) + self.finish()


def transducer(path: str) -> Transducer:
    return kept_in_worker(f"bpe {path}", lambda: Transducer(Vocabulary(path)))


def encode(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Append the token ids of every whole text, packed as little-endian unsigned 32-bit.

    Null and empty texts have no ids. Equal rows give equal results, an empty table an empty
    one; other columns stay, one called ``name`` is replaced. The vocabulary file must be
    readable under ``path`` on every executor.
    """

    def ids(column):
        encode_one = transducer(path).encode
        return [[encode_one(value or "") for value in column.to_pylist()]]

    return append_columns(df, [text], f"`{name}` binary", ids)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Append the text of packed ids.

    Null counts as no ids and gives an empty text; unknown ids stand for nothing; bytes that are
    no UTF-8 become replacement characters. A column of ``df`` named like the new one is replaced,
    others stay. Equal rows give equal texts, an empty table an empty one.
    """

    def texts(column):
        table = kept_in_worker(f"token bytes {path}", lambda: token_bytes(read_spec(path)))
        decode_one = ByteDecoder(table).decode
        return [[decode_one(value or b"") for value in column.to_pylist()]]

    return append_columns(df, [ids], f"`{name}` string", texts)
