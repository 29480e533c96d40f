"""Shared helpers: tables in the shared folder, Arrow text buffers, words and their hashes.

Texts are handled in slices of about half a megabyte with numpy, inside tasks that Spark deals out.
A NULL text is the empty text everywhere. Word identities are 64-bit hashes of the bytes.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qagrade.plans.harness import ensure_folder
from qagrade.sources.scratch import pin, unpin

#: Words are runs of anything but the space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19
#: Polynomial hashes modulo 2^64 are safe for short strings only; longer words get a digest.
LONG_WORD = 512

_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """`n` fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _splitmix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15))


_BYTE = random_words(256, 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POSITION = random_words(64, 2) | _U(1)


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers_for(n: int, base: int) -> np.ndarray:
    return _powers(max(1 << max(1, n - 1).bit_length(), 1 << 20), base)


# --- session and tables -------------------------------------------------------------------


def ship(spark: SparkSession) -> None:
    """Give the package to the workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_qagrade_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="qagrade-"), "qagrade.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._qagrade_shipped = True


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    ensure_folder(spark)
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there."""
    return pin(df, f"llm-{name}", compression=compression, **options)


#: Delete stored tables that no later step reads; what is left goes with the operator's scope.
discard = unpin


#: Bytes of texts that are handed to a Python worker at once, unless the session sets another number.
ARROW_BYTES = 8 << 20
STAGE_BYTES = 2 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Workers hold a batch of texts and what is made of it, so long texts need small batches."""
    if not spark.sparkContext.getConf().contains(_ARROW) and (
        spark.conf.get(_ARROW).startswith("67108864") or size < ARROW_BYTES and spark.conf.get(_ARROW) == str(ARROW_BYTES)
    ):
        spark.conf.set(_ARROW, str(size))


def ship_stage(spark: SparkSession) -> None:
    """For a stage of several in the same workers, whose memory adds up: smaller batches still."""
    ship(spark)
    _small_batches(spark, STAGE_BYTES)


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only; other columns may have any name. Names have to be unique as Spark
    compares them, by default without case."""
    ship(docs.sparkSession)
    _small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A table that a worker keeps between tasks, until it gets texts for another operator."""
    _CACHES.append({})
    return _CACHES[-1]


# --- texts ---------------------------------------------------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column, NULL as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def row_bounds(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row): whole texts, about `limit` bytes at once."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes): whole texts, about `limit` bytes at once."""
    for cache in _CACHES:
        cache.clear()
    offsets, data = buffers(column)
    for row, end in row_bounds(offsets, limit):
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Words of the texts of a slice: byte bounds, text number and, on demand, hashes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, blank: np.ndarray = _SPACE):
        self.offsets, self.data = offsets, data
        n = len(data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~blank[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1])) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        #: Number of words before each text, and of all at the end.
        self.first = np.searchsorted(self.start, offsets, "left")
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `k` words within one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, window_hashes(self.hashes, k)[at]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        n = len(data)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * _powers_for(n + 1, _BASE)[:n], out=total[1:])
        length = end - start
        value = (total[end] - total[start]) * _powers_for(n + 1, _UNBASE)[start]
        out = _splitmix(value + length.astype(_U) * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every `k` neighbouring hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, _U)
        for j in range(k):
            total += hashes[j : j + n] * _POSITION[j]
        return _splitmix(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of hashes of any length."""
    digest = hashlib.blake2b(np.ascontiguousarray(hashes).tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little")


def shingle_sets(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct shingle hashes): `k` words each; with fewer words, all of them
    as one; nothing without words."""
    at, value = words.windows(k)
    bounds = np.searchsorted(at, words.first, "left")
    for i in range(len(words.offsets) - 1):
        n = words.first[i + 1] - words.first[i]
        if n >= k:
            yield i, np.unique(value[bounds[i] : bounds[i + 1]])
        elif n:
            yield i, np.array([sequence_hash(words.hashes[words.first[i] : words.first[i + 1]])], _U)
        else:
            yield i, np.zeros(0, _U)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# --- filters of keys ------------------------------------------------------------------------

#: Bits of a filter: about 256 a key, within these bounds (16 MB at most).
FILTER_BITS = (20, 27)
_SEGMENT_BITS = 20


class KeyFilter:
    """A bitmap of the first and the last bits of 64-bit keys: it passes all of them and few others."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def _marked(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = self._marked(keys >> _U(64 - self.bits))
        maybe = np.flatnonzero(out)
        out[maybe] = self._marked(keys[maybe] & _U((1 << self.bits) - 1))
        return out


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of a table's column `key`, a long; made in segments by tasks, of a bounded size."""
    wanted = int(256 * max(keys.count(), 1)).bit_length()
    bits = min(max(wanted, FILTER_BITS[0]), FILTER_BITS[1])
    size = 1 << _SEGMENT_BITS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(_U)
            at = np.unique(np.concatenate([key >> _U(64 - bits), key & _U((1 << bits) - 1)])).astype(np.int32)
            ends = np.append(np.flatnonzero(np.diff(at // size, prepend=-1)), len(at))
            places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array((at[ends[:-1]] // size).astype(np.int64)), places], ["segment", "places"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).flatten().to_numpy()
            segments = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            for segment in np.unique(batch.column(0).to_numpy()):
                marked = found.setdefault(int(segment), np.zeros(size, bool))
                marked[at[segments == segment] % size] = True
        for segment, marked in found.items():
            packed = np.packbits(marked, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([packed])], ["segment", "bits"])

    # one row a batch and segment: places one by one cost a shuffled row for each end of each key
    places = keys.select("key").mapInArrow(deal, "segment long, places array<int>").repartition("segment")
    rows = places.mapInArrow(build, "segment long, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for i, packed in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[i * size // 8 : (i + 1) * size // 8] |= np.frombuffer(packed, np.uint8)
    return KeyFilter(bits, out)
