"""Encoding of a corpus with a public byte-level BPE tokenizer.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash: its 64-bit hash picks a bucket, the
bucket's displacement picks a slot, and the bytes kept for that slot confirm it. Every other pre-token is merged from its
bytes, a heap giving the lowest-ranked pair of a linked list again and again. Each worker remembers the pre-tokens it has
resolved.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
_BUCKET_KEYS = 3
_MASK = (1 << 64) - 1


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank per line) by their ids."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    return [ranks[i] for i in range(len(ranks))]


def _mix(h: int, seed: int) -> int:
    h = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _MASK
    return h ^ (h >> 29)


class PerfectHash:
    """A minimal perfect hash of distinct keys: as many slots as keys, one displacement per bucket, none of the keys stored.

    Buckets of several keys search a displacement that puts them into free slots; a bucket of one key then names a free
    slot outright, as a negative displacement.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, -(-len(keys) // _BUCKET_KEYS))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append(h)
        self.seeds = np.zeros(self.buckets, np.int32)
        taken = bytearray(self.n)
        for b in sorted((b for b in range(self.buckets) if len(members[b]) > 1), key=lambda b: -len(members[b])):
            hashes, seed = members[b], 1
            while True:
                slots = {(_mix(h, seed) % self.n) for h in hashes}
                if len(slots) == len(hashes) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for s in slots:
                taken[s] = 1
        free = (s for s in range(self.n) if not taken[s])
        for b in range(self.buckets):
            if len(members[b]) == 1:
                self.seeds[b] = -1 - next(free)
        self.displacement = self.seeds.tolist()

    def slot(self, key: bytes) -> int:
        """The slot of a key; some slot for anything that is none."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.displacement[h % self.buckets]
        return _mix(h, seed) % self.n if seed >= 0 else -1 - seed


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a pre-token by merging its bytes: the lowest-ranked neighbours first, the leftmost among equals."""
    n = len(data)
    ends = list(range(1, n + 1))  # of the piece that begins at a place; 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, left, end = heappop(heap)
        middle = ends[left]
        if not middle or middle >= end or ends[middle] != end:
            continue  # one of the two pieces has changed since
        ends[left], ends[middle] = end, 0
        if end < n:
            before[end] = left
            if (rank := ranks.get(data[left : ends[end]])) is not None:
                heappush(heap, (rank, left, ends[end]))
        if (p := before[left]) >= 0 and (rank := ranks.get(data[p:end])) is not None:
            heappush(heap, (rank, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : ends[i]]])
        i = ends[i]
    return tuple(out)


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    """The public splitting pattern with its Unicode classes written out, so that the standard library's faster matcher can run it."""

    def spans(kind: str) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    letters, numbers = spans("L"), spans("N")
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


#: The same pattern for texts of ASCII characters alone.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Encoder(dict):
    """Maps a pre-token to its ids; what it hasn't met yet is looked up in the two tiers."""

    def __init__(self, vocabulary: list[bytes], hashed: PerfectHash | None = None) -> None:
        super().__init__()
        self.hashed = hashed or PerfectHash(vocabulary)
        self.ranks = {token: i for i, token in enumerate(vocabulary)}
        self.slots: list[tuple[bytes, tuple[int, ...]]] = [(b"", ())] * len(vocabulary)
        for i, token in enumerate(vocabulary):
            self.slots[self.hashed.slot(token)] = (token, (i,))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        token, ids = self.slots[self.hashed.slot(data)]
        if token != data:
            ids = merge_bytes(data, self.ranks)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        if not text:
            return []
        pieces = (_ASCII if text.isascii() else _pattern()).findall(text)
        return list(chain.from_iterable(map(self.__getitem__, pieces)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(read_vocabulary(path))


def encode_corpus(df: DataFrame, row_id: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(row_id, ids): the token ids of each text, without special tokens; strings that look like one are ordinary text.

    An empty and a null text have an empty list. Texts of any length are used whole, one row per row; an empty table gives
    an empty result. The vocabulary must be readable at the same path on each worker; it is a file of fixed size.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    kind = dict(df.dtypes)[row_id]
    found = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"id {kind}, ids array<int>")
    return found.select(F.col("id").alias(row_id), "ids")
