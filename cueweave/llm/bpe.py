"""Byte-level BPE encoding and decoding by tree reduction.

A piece of text (one match of the splitting pattern) is encoded by halves: both
halves are encoded, then joined. The join re-encodes a window of tokens around
the border and lets it grow until the tokens outside provably stay. The proof:
ranked merging of a string gives exactly the tokens t1 ... tn if and only if it
gives (ti, ti+1) for each pair of neighbours, since merges inside one token
never look beyond it, and the first merge across a border would also be the
first one when the two tokens stand alone. So a join is final once the pairs at
both ends of the re-encoded window are stable, and concatenation of token lists
is an associative reduction with the empty list as its unit. Decoding
concatenates up a tree as well.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cueweave.llm.common import process_state, slices

#: White space of the splitting patterns (the Unicode property), beside the plain space.
WHITE = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries that a worker's cache of words may hold before it starts anew.
CACHED_WORDS = 300_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """token → rank of a rank file (base64, space, number per line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class TreeEncoder:
    """Tokens of a piece of bytes, by halves.

    Short halves and pairs of tokens recur in all words, so both are kept, up to
    a fixed number of entries.
    """

    SHORT = 6

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.short: dict[bytes, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        """A whole piece; one that is a token itself needs no merging."""
        own = self.ranks.get(data)
        return (own,) if own is not None else self.tree(data)

    def tree(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        if n > self.SHORT:
            return self.join(self.tree(data[: n // 2]), self.tree(data[n // 2 :]))
        found = self.short.get(data)
        if found is None:
            if len(self.short) >= CACHED_WORDS:
                self.short.clear()
            if n <= 1:
                found = (self.ranks[data],) if data else ()
            else:
                found = self.join(self.tree(data[: n // 2]), self.tree(data[n // 2 :]))
            self.short[data] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        a, b = left[-1:], right[:1]
        window = self.pair(*a, *b)
        if window == a + b:
            return left + right
        while True:
            before, after = left[: len(left) - len(a)], right[len(b) :]
            if (not before or self.pair(before[-1], window[0]) == (before[-1], window[0])) and (
                    not after or self.pair(window[-1], after[0]) == (window[-1], after[0])):
                return before + window + after
            a, b = left[-2 * len(a) :], right[: 2 * len(b)]
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, a + b)))

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """What two neighbouring tokens become; a stable border gives (a, b)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= 2 * CACHED_WORDS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b])
        return found

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Ranked merging of a window: the lowest rank first, of equal ones the leftmost."""
        ranks = self.ranks
        if len(data) > 64:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap and links, for windows that had to grow."""
        n = len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := self.ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0 and (r := self.ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(self.ranks[data[i : end[i]]] for i in range(n) if alive[i])


def packed(ids: list[int]) -> bytes:
    """Unsigned 32-bit numbers, little-endian."""
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


class Words(dict):
    """word → packed tokens of a space and the word; computed when asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = self.encode(" " + word)
        return found


class TextEncoder:
    """Packed tokens (unsigned 32-bit, little-endian) of whole texts.

    A single space between two visible characters always begins a match of the
    pattern, so most texts fall into cacheable words without running it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tree = TreeEncoder(ranks)
        # \s of the pattern is the Unicode property; named explicitly, as libraries differ.
        self.pattern = regex.compile(pattern)
        self.odd = re.compile(f"[{WHITE.replace(chr(10), '')}]| [ \n]|\n |^ | $")
        self.words = Words(self.matches)

    def matches(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.tree.piece(piece.encode("utf-8"))
        return packed(ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        return self.matches(first) + b"".join(map(self.words.__getitem__, rest))


def concatenated(parts: list[bytes], fan: int = 1024) -> bytes:
    """Joins up a tree whose nodes have `fan` children."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + fan]) for i in range(0, len(parts), fan)]
    return parts[0] if parts else b""


def _decoder(ranks: dict[bytes, int]) -> Callable[[bytes], bytes]:
    table = {v: k for k, v in ranks.items()}
    return lambda ids: concatenated(list(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())))


def _shipped(frame: DataFrame, path: str):
    with open(path, "rb") as f:
        return frame.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte


def encode(frame: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """`key`, `ids`: packed tokens of each whole text (unsigned 32-bit, little-endian).

    `decoded` adds the bytes that the tokens decode to. One row per input row;
    repeated rows give equal rows. A null or empty text has empty `ids`; a null
    key stays null; an empty table gives none. Other columns are not read, so
    their names cannot clash. No shuffle: memory is one slice of texts.
    """
    content, kind = _shipped(frame, ranks_path), dict(frame.dtypes)[key]
    schema = f"`{key}` {kind}, ids binary" + (", decoded binary" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = process_state(("ranks", ranks_path), lambda: read_ranks(content.value))
        encoder = process_state(("encoder", ranks_path, pattern), lambda: TextEncoder(ranks, pattern))
        back = process_state(("decoder", ranks_path), lambda: _decoder(ranks))
        for batch in slices(batches, text):
            ids = [encoder(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(key), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([back(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    return frame.select(key, text).mapInArrow(run, schema)


def decode(frame: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key`, `decoded`: the bytes of packed tokens; null or empty `ids` give none.

    An id outside the vocabulary raises KeyError. Other columns are not read.
    """
    content, kind = _shipped(frame, ranks_path), dict(frame.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = process_state(("ranks", ranks_path), lambda: read_ranks(content.value))
        back = process_state(("decoder", ranks_path), lambda: _decoder(ranks))
        for batch in slices(batches, ids):
            data = [back(x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(data, pa.binary())], [key, "decoded"])

    return frame.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded binary")
