"""Byte-level BPE by two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a token as a whole.
Tier two: any other pre-token is merged byte by byte, a heap choosing the lowest-ranked (then leftmost)
pair of a linked list. What a worker has resolved it keeps in a bounded cache, so that a text is one
regular-expression pass and one join.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, in_batches, small_batches, text_of

#: Pre-tokens that one worker's cache holds before it starts anew, and the longest that it takes.
CACHE_ENTRIES = 400_000
CACHE_LONGEST = 64

_BY_FILE: dict[tuple[str, str], "ByteBpe"] = {}


def load_ranks(file: str) -> dict[bytes, int]:
    """Ranks of a file of lines `base64 rank`."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings onto 0..n-1, by levels of collision-free bits.

    Level by level, a key takes a position of a bit array twice as long as the keys that remain; keys
    alone at theirs are settled there, the others go on. A key's number is its bit's rank. A string that
    isn't a key may get any number, so callers compare the key kept under it.
    """

    def __init__(self, keys: list[bytes]):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        hashes, base, seed = self.hashed(keys), 0, 1
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("keys repeat, or 64 bits don't tell them apart")
        while len(hashes):
            size = max(64, 2 * len(hashes))
            at = self._place(hashes, seed, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((seed, alone, np.cumsum(alone) - alone + base, size))
            base += int(alone.sum())
            hashes, seed = hashes[~alone[at]], seed + 1
        self.n = base

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _place(hashes: np.ndarray, seed: int, size: int) -> np.ndarray:
        x = hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, -1 for some strings that aren't keys."""
        hashes = self.hashed(keys)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, alone, rank, size in self.levels:
            at = self._place(hashes[rest], seed, size)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by repeatedly joining its lowest-ranked, then leftmost, neighbours."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at a position; 0 once it is joined to the one before
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, mid, right = heapq.heappop(heap)
        if end[left] != mid or end[mid] != right:
            continue  # one of the two has been joined to another since
        end[left], end[mid] = right, 0
        if right < n:
            before[right] = left
            if (rank := ranks.get(piece[left : end[right]])) is not None:
                heapq.heappush(heap, (rank, left, right, end[right]))
        if (at := before[left]) >= 0 and (rank := ranks.get(piece[at:right])) is not None:
            heapq.heappush(heap, (rank, at, left, right))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"no token for the byte {lacking[0]}")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        self.packed = [b""] * len(ranks)
        for key, number in zip(ranks, self.hash.numbers(list(ranks)).tolist()):
            self.keys[number], self.packed[number] = key, ranks[key].to_bytes(4, "little")
        self.tokens = dict(zip(ranks.values(), ranks))
        self.cache: dict[str, bytes] = {}

    def resolve(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens: whole tokens by the perfect hash, the others by merges."""
        raw = [p.encode("utf-8") for p in pieces]
        found = []
        for key, number in zip(raw, self.hash.numbers(raw).tolist()):
            if number >= 0 and self.keys[number] == key:
                found.append(self.packed[number])
            else:
                found.append(np.array(merge(key, self.ranks), "<u4").tobytes())
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = self.cache
        new = list(set().union(*split).difference(known))
        own = dict(zip(new, self.resolve(new)))
        known.update((p, ids) for p, ids in own.items() if len(p) <= CACHE_LONGEST)
        long = {p: ids for p, ids in own.items() if len(p) > CACHE_LONGEST}
        if not long:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return [b"".join([known[p] if p in known else long[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(file: str, pattern: str) -> ByteBpe:
    """This worker's encoder for a file."""
    if (file, pattern) not in _BY_FILE:
        _BY_FILE[file, pattern] = ByteBpe(load_ranks(file), pattern)
    claim(_BY_FILE[file, pattern].cache)
    return _BY_FILE[file, pattern]


def encode(df: DataFrame, ranks: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text.

    Null text counts as empty and has no ids. Ids may be null or repeat: each row gives one row. Other
    columns are ignored. Strings of special tokens are ordinary text. One pass, no shuffle; a task holds
    256 texts and a bounded cache.
    """

    def run(batches):
        import pyarrow as pa

        own, schema = byte_bpe(ranks, pattern), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    yield from zip(some.column(0).to_pylist(), own.encode(some.column(1).to_pylist()))

        yield from in_batches(rows(), schema, weigh=lambda r: len(r[1]) + 16)

    small_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of encode() with `decoded`, the bytes that the ids stand for. Null ids count as none; an unknown id is an error."""

    def run(batches):
        import pyarrow as pa

        own, schema = byte_bpe(ranks, pattern), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

        def rows():
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield doc, ids or b"", own.decode(ids or b"")

        yield from in_batches(rows(), schema, weigh=lambda r: 2 * len(r[1]) + 16)

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
