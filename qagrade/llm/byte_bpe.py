"""Byte-level BPE: encoding and decoding by a table of ranks.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash: a bucket's
displacement sends each of its keys to a slot of its own, and the token found there is compared
with the key. Other pre-tokens are merged by a heap of (rank, position) over linked bytes. Both
results are kept in bounded memos of the worker, first for whole runs between single spaces,
then for pre-tokens, since the words of a corpus repeat.

Defined results: a NULL text is the empty text and has no ids; rows repeat as they are; other
columns are kept by `encode`, and those named like its outputs are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from qagrade.llm.common import buffers, narrow, row_bounds, worker_cache

#: Entries of each half of a memo; when the new half is full it becomes the old one.
MEMO_ENTRIES = 150_000
#: Those of a pass that has the workers' memory to itself; `encode` may follow other operators.
ROUND_TRIP_ENTRIES = 400_000
_BITS = 20
_CODECS: dict[str, Codec] = worker_cache()


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 tokens and ranks."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have to be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of distinct keys: as many slots as keys."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slot = [-1] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                at = [self._place(hashes[i], d) for i in own]
                if len(set(at)) == len(at) and all(self.slot[x] < 0 for x in at):
                    break
                d += 1
            self.shift[b] = d
            for i, x in zip(own, at, strict=True):
                self.slot[x] = i
        free = iter([x for x in range(n) if self.slot[x] < 0])
        for b, own in enumerate(groups):
            if len(own) == 1:  # a key alone in its bucket is sent to a free slot directly
                x = next(free)
                self.shift[b] = -x - 1
                self.slot[x] = own[0]

    def _place(self, h: int, d: int) -> int:
        mixed = (h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (mixed ^ mixed >> 29) % self.n

    def find(self, key: bytes) -> int:
        """Number of the only key that `key` can be."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slot[-d - 1 if d < 0 else self._place(h, d)]


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, perfect: PerfectHash | None = None, entries: int = MEMO_ENTRIES):
        self.tokens, self.entries = tokens, entries
        self.perfect = perfect or PerfectHash(tokens)
        self.split = regex.compile(pattern).findall
        self.odd = regex.compile(r"\s\s|\s $|^ ").search
        known = {t: i for i, t in enumerate(tokens)}
        self.byte = [known[bytes([b])] for b in range(256)]
        self.pairs = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a << _BITS | b] = i
        self.packed = [int(i).to_bytes(4, "little") for i in range(len(tokens))]
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging the neighbours of least rank, leftmost first."""
        ids = [self.byte[b] for b in piece]
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = get(ids[i] << _BITS | ids[i + 1])
            if rank is not None:
                heap.append(rank << 40 | i)
        heapq.heapify(heap)
        pop, push, low = heapq.heappop, heapq.heappush, (1 << 40) - 1
        while heap:
            top = pop(heap)
            i, rank = top & low, top >> 40
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << _BITS | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := get(rank << _BITS | ids[k])) is not None:
                    push(heap, new << 40 | i)
            if (p := before[i]) >= 0 and (new := get(ids[p] << _BITS | rank)) is not None:
                push(heap, new << 40 | p)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """Packed ids of a pre-token."""
        key = text.encode()
        found = self.perfect.find(key)
        if self.tokens[found] == key:
            return self.packed[found]
        packed = self.packed
        return b"".join([packed[i] for i in self.merge(key)])

    def _pieces(self, texts: list[str]) -> bytes:
        memo, out = self.pieces, []
        for t in texts:
            ids = memo.get(t)
            if ids is None:
                ids = self.old_pieces.get(t)
                if ids is None:
                    ids = self.piece(t)
                if len(t) <= 64:
                    memo[t] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _run(self, run: str) -> bytes:
        """Packed ids of a run and the space before it; its first pre-token is kept as a run, and once."""
        ids = self.runs.get(run) or self.old_runs.get(run)
        if ids is None:
            own = self.split(" " + run)
            if len(own) == 1:
                ids = self.piece(own[0])
            elif own and own[0][0] == " " and self.split(own[0]) == own[:1]:
                ids = self._run(own[0][1:]) + self._pieces(own[1:])
            else:
                ids = self._pieces(own)
        if len(run) <= 64:
            self.runs[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > self.entries:
            self.pieces, self.old_pieces = {}, self.pieces
        if len(self.runs) > self.entries:
            self.runs, self.old_runs = {}, self.runs
        if " " not in text or self.odd(text):
            return self._pieces(self.split(text))
        # Single spaces between others: each starts a pre-token, so runs can be split alone.
        first, *rest = text.split(" ")
        found = list(map(self.runs.get, rest))
        if None in found:
            found = [ids or self._run(run) for ids, run in zip(found, rest, strict=True)]
        return self._pieces(self.split(first)) + b"".join(found)

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def _codec(key: str, shared, entries: int = MEMO_ENTRIES) -> Codec:
    """One codec a worker and vocabulary, kept between tasks."""
    if key not in _CODECS:
        tokens, pattern, perfect = shared.value
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern, perfect)
    _CODECS[key].entries = entries
    return _CODECS[key]


def _shared(df: DataFrame, path: str, pattern: str):
    tokens = read_ranks(path)
    key = hashlib.sha256(pattern.encode() + b"\0".join(tokens)).hexdigest()
    return key, df.sparkSession.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens)))


def _encoded(codec: Codec, batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch with its ids and their number, some rows at once: ids are longer than their texts."""
    at = batch.schema.get_field_index(text)
    for row, end in row_bounds(buffers(batch.column(at))[0]):
        part = batch.slice(row, end - row)
        ids = [codec.encode(t or "") for t in part.column(at).to_pylist()]
        count = pa.array([len(x) // 4 for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(ids, pa.binary()), count], [*batch.schema.names, "ids", "n_tokens"]
        )


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (binary, little-endian unsigned 32-bit) and `n_tokens`.

    `pattern` must not let a pre-token go past a single space that stands between two other
    characters except at its own start, as those of the public byte-level vocabularies do not.
    """
    key, shared = _shared(docs, path, pattern)
    docs = docs.drop("ids", "n_tokens")
    schema = StructType([*docs.schema.fields, StructField("ids", BinaryType()), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            yield from _encoded(codec, batch, text)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encoded` with `decoded`, the bytes of its ids; NULL ids give NULL."""
    key, shared = _shared(encoded, path, pattern)
    encoded = encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            out = [None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass over it: doc_id, n_tokens and digests of both."""
    key, shared = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, ROUND_TRIP_ENTRIES)
        for batch in batches:
            count, ids_digest, bytes_digest = [], [], []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t or "")
                count.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                bytes_digest.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_digest), pa.array(bytes_digest)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
