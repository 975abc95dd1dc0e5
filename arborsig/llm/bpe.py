"""Byte-level BPE encoding with a public vocabulary.

The merge loop uses a hierarchical-bitmap rank queue: one bucket for each merge rank holds the positions (in a
linked list over the bytes of a pre-token) whose pair merges with that rank, a three-level bitmap tells the lowest
rank whose bucket isn't empty by find-first-set, and entries that merges have made stale are skipped when they come up.
A pre-token of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's text is cut into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a worker remembers, and the longest it does; both bound its memory and not the result.
CACHED, CACHED_CHARS = 400_000, 64


class RankQueue:
    """Positions by rank, lowest rank first and leftmost first within a rank."""

    __slots__ = ("top", "mid", "low", "bucket")

    def __init__(self):
        self.top, self.mid, self.low, self.bucket = 0, {}, {}, {}

    def push(self, rank: int, pos: int) -> None:
        held = self.bucket.get(rank)
        if held:
            heappush(held, pos)
            return
        self.bucket[rank] = [pos]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        held = self.bucket[rank]
        pos = heappop(held)
        if not held:
            w &= w - 1
            self.low[a] = w
            if not w:
                m &= m - 1
                self.mid[b] = m
                if not m:
                    self.top &= self.top - 1
        return rank, pos


class Encoder(dict):
    """Maps a pre-token to the tuple of its ids, working out those not seen before."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.findall = regex.compile(PATTERN).findall

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [-1] * n  # the rank of the pair that begins here
        queue = RankQueue()
        for i in range(n - 1):
            r = ranks.get(part[i] + part[i + 1], -1)
            now[i] = r
            if r >= 0:
                queue.push(r, i)
        while (at := queue.pop()) is not None:
            rank, i = at
            if now[i] != rank:
                continue  # stale: a merge since has changed or taken away this pair
            j = after[i]
            k = after[j]
            part[i] += part[j]
            part[j] = b""
            now[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                r = ranks.get(part[i] + part[k], -1)
                now[i] = r
                if r >= 0:
                    queue.push(r, i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = ranks.get(part[h] + part[i], -1)
                now[h] = r
                if r >= 0:
                    queue.push(r, h)
        return [ranks[p] for p in part if p]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str):
        """An iterator over the ids of the whole text."""
        return chain.from_iterable(map(self.__getitem__, self.findall(text)))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.findall(text))))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def encode_ids(df: DataFrame, key: str, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each text without special tokens.

    Null and empty texts have an empty list.  Strings that look like special tokens are ordinary text.  Every row
    gives one row, repeated ones too.  ``vocabulary`` is a file that every executor can read.
    """
    rows = spread(df.select(key, text))
    field = rows.schema[key]

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            ids, ends = array("i"), [0]
            for t in b.column(1).to_pylist():
                if t:
                    ids.extend(enc.encode(t))
                ends.append(len(ids))
            values = pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each text; 0 for null and empty ones."""
    rows = spread(df.select(key, text))
    field = rows.schema[key]

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            n = [enc.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return rows.mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, n_tokens bigint")
