"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallywise.llm.batches import kept_by_worker, with_computed

_STATES = 1 << 16  # determinised states that a task remembers
_DEEP = 6  # bytes of a short piece after which no new state is made: it would hardly be met again
_PAIRS, _RANK_BITS = 1 << 19, 32  # judged token pairs, each as one number
_PIECES, _LONGEST = 1 << 18, 64  # encoded pieces, and the characters of the longest one that is remembered
_WAYS, _REST = -1, -2
_STREAM = 1 << 16  # ids that the decoder takes at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Reads bytes of one piece, writes token ids.

    A sequence of tokens is what the merges make of its bytes exactly if each two neighbours are (no merge that comes
    earlier crosses their border), so reading is a walk through the vocabulary's trie: whenever the bytes since the last
    token spell a token that may follow it, a new token may begin. Of the possible ways exactly one has just ended a token
    at any byte. A determinised state is the set of all ways still open, each with the ids not yet written; ids are
    written as soon as all ways agree on them, so at most the longest token's length is ever looked ahead. States and
    their transitions are made when first met; where a short piece leaves the known ones late, its ways are followed to its
    end one by one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[bytes, int] = {}  # tokens that the merges don't make; they count for whole pieces only
        for spelling, rank in ranks.items():
            if len(spelling) > 1 and not self._halves(rank):
                self.whole[spelling] = rank
                continue
            node = 0
            for byte in spelling:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.begin = self._state((((), -1, 0),))

    def _state(self, ways: tuple) -> dict:
        """Byte to next state and ids to write; ``_WAYS``: what the state stands for, ``_REST``: ids due if input ends."""
        state = self.states.get(ways)
        if state is None:
            state = {_WAYS: ways, _REST: next((pending for pending, _, node in ways if node == 0), ())}
            self.states[ways] = state
        return state

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a byte or a token that merges don't make."""
        if rank not in self.halves:
            spelling = self.spelling[rank]
            parts = [spelling[i : i + 1] for i in range(len(spelling))]
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    found = self.ranks.get(parts[i] + parts[i + 1], rank)
                    if found < best:
                        best, at = found, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = len(parts) == 2 and all(p in self.ranks for p in parts)
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if known else None
        return self.halves[rank]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart: undo their merges, the latest first, and look at the border."""
        pair = left << _RANK_BITS | right
        apart = self.pairs.get(pair)
        if apart is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[pair] = apart = self._apart(left, right)
        return apart

    def _apart(self, left: int, right: int) -> bool:
        before = float("inf")  # a merge of lower rank than this would have crossed the border first
        ranks, spelling, halves = self.ranks, self.spelling, self.halves
        while True:
            across = ranks.get(spelling[left] + spelling[right])
            if across is not None and across < before:
                return False
            inner_left, inner_right = halves.get(left), halves.get(right)  # bytes have none
            if inner_left and (left > right or not inner_right):
                before, left = left, inner_left[1]
            elif inner_right:
                before, right = right + 1, inner_right[0]  # of equal merges the left one comes first
            else:
                return True

    def _moved(self, ways: Iterable[tuple], byte: int) -> list[tuple]:
        """The ways after one more byte, in the order in which their last token began; the last has just ended a token."""
        moved, ended = [], None
        children, tokens, pairs = self.children, self.token, self.pairs
        for pending, last, node in ways:
            node = children[node].get(byte)
            if node:
                if ended is None:
                    rank = tokens[node]
                    if rank >= 0:
                        apart = True if last < 0 else pairs.get(last << _RANK_BITS | rank)
                        if self.follows(last, rank) if apart is None else apart:
                            ended = ((*pending, rank), rank, 0)
                if children[node]:
                    moved.append((pending, last, node))
        moved.append(ended)
        return moved

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        ways = self._moved(state[_WAYS], byte)
        due = ways[0][0]  # the way that began first has the fewest ids to write
        for pending, _, _ in ways[1:] if due else ():
            agreed = 0
            while agreed < len(due) and due[agreed] == pending[agreed]:
                agreed += 1
            due = due[:agreed]
        if due:
            ways = [(pending[len(due) :], last, node) for pending, last, node in ways]
        if len(self.states) >= _STATES:
            self._forget()
        state[byte] = found = (self._state(tuple(ways)), due)
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.whole:
            return (self.whole[piece],)
        state, written, short = self.begin, (), len(piece) <= _LONGEST
        for at, byte in enumerate(piece[:-1]):
            found = state.get(byte)
            if found is None:
                if short and at >= _DEEP:
                    ways = state[_WAYS]
                    for byte in piece[at:-1]:
                        ways = self._moved(ways, byte)
                    return written + self._last(ways, piece[-1])
                found = self._step(state, byte)
            state, out = found
            if out:
                written += out
        return written + (self._end(state, piece[-1]) if piece else ())

    def _end(self, state: dict, byte: int) -> tuple[int, ...]:
        """Ids due when the input ends with this byte; the state after it is not made for that."""
        if byte in state:
            state, out = state[byte]
            return out + state[_REST]
        return self._last(state[_WAYS], byte)

    def _last(self, ways: Iterable[tuple], byte: int) -> tuple[int, ...]:
        children, tokens, pairs = self.children, self.token, self.pairs
        for pending, last, node in ways:
            rank = tokens[children[node].get(byte, 0)]
            if rank >= 0:
                apart = True if last < 0 else pairs.get(last << _RANK_BITS | rank)
                if self.follows(last, rank) if apart is None else apart:
                    return (*pending, rank)
        raise ValueError("the vocabulary lacks a byte")


class Encoder(dict):
    """Piece to ids, remembering a bounded number of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.bytes = self.transducer.spelling

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= _PIECES:  # what was met since the last time stays at hand
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece) or self.transducer.encode(piece.encode("utf-8"))
        if len(piece) <= _LONGEST:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, in parts that never end inside a character."""
        stream, ids = Utf8Stream(), list(ids)
        for low in range(0, len(ids), _STREAM):
            yield stream.feed(b"".join(map(self.bytes.__getitem__, ids[low : low + _STREAM])))
        yield stream.end()


class Utf8Stream:
    """Incremental UTF-8: the state is the bytes of a character that has begun and not ended."""

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte >= 0xC0:  # a leading byte: how many should follow?
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut -= back if need > back else 0
                break
            if byte < 0x80:
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


def _encoder(ranks_path: str, pattern: str, ranks: dict[bytes, int]) -> Encoder:
    return kept_by_worker(("bpe", ranks_path, pattern, len(ranks)), lambda: Encoder(ranks, pattern))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the tokens of the whole text; a null text counts as empty. No shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary, whatever the input

    def start():
        coder = _encoder(ranks_path, pattern, ranks.value)
        return lambda b: [pa.array([coder.encode(t.as_py() or "") for t in b.column(text_col)], pa.list_(pa.int32()))]

    return with_computed(docs, "ids array<int>", start, ("bpe",))


def decode_ids(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with ``into``, the text of the ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        coder = _encoder(ranks_path, pattern, ranks.value)
        return lambda b: [pa.array(["".join(coder.decode(x.as_py() or ())) for x in b.column(ids_col)], pa.string())]

    return with_computed(docs, f"`{into}` string", start, ("bpe",))


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``.

    Encodes each whole text, then decodes the ids as a stream, in one pass over the rows; ``with_ids`` adds ``ids`` (array
    of int). A null text counts as empty: no tokens. Columns of these names are replaced. No shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        coder = _encoder(ranks_path, pattern, ranks.value)
        decimal = {rank: str(rank) for rank in coder.bytes}

        def digests(text: str) -> tuple:
            ids, decoded = coder.encode(text), hashlib.sha256()
            for part in coder.decode(ids):
                decoded.update(part.encode("utf-8"))
            joined = ",".join(map(decimal.__getitem__, ids))
            digest = hashlib.sha256(joined.encode("ascii")).hexdigest()
            return len(ids), digest, decoded.hexdigest(), np.array(ids, np.int32) if with_ids else None

        def compute(b: pa.RecordBatch) -> list:
            found = list(zip(*(digests(t.as_py() or "") for t in b.column(text_col)))) or [[], [], [], []]
            return [pa.array(x, t) for x, t in zip(found, kinds)]

        return compute

    kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if with_ids else [])]
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return with_computed(docs, fields, start, ("bpe",))
