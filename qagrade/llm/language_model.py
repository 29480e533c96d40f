"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has, in every context of 0 to `DEPTH` bytes, a
Krichevsky-Trofimov estimate, and the estimates of all depths of a context are mixed with the
weights of the context tree. Counts of all byte strings of `DEPTH` + 1 bytes of the training
texts are gathered by Spark. The tree has every context that the training texts hold at least
`LEAST` times, so it grows with them; those of a parent that occur once share one leaf, so every
training byte counts. A text's score is the log10 probability of its bytes and its end.

No task and not the driver ever has the whole tree. Strings whose nearest `LOW` context bytes are
equal are a subtree, weighted in one task; the tree above them (65,536 contexts of `LOW` - 1 bytes
at most, as there are not more) is finished on the driver and sent back. The result is a stored
table of the log10 of every string that any text has. Texts are cut into chunks of `CHUNK` bytes;
the distinct strings of a chunk are joined to that table and go back to the chunk's texts.

Beside it stands the base score of a smoothed word table. Words with at least one in 2^17 of all
training tokens (there cannot be more than 2^17 of them) are sent to the tasks; the others are
joined by their hashes and summed for each text again.

Training texts are those outside the held-out fifth. Defined results: NULL and empty texts are
their end alone; rows repeat as they are, also as training texts; a NULL id trains and is not
held out; with no training text N and V are 0 and the base score is that of 0.5 / 0.5 a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qagrade.llm.anchors import release
from qagrade.llm.common import Words, discard, lowered, narrow, slices, stored
from qagrade.llm.toxicity import held_out
from qagrade.sources.scratch import scoped

DEPTH = 5
LEAST = 2
LOW = 3
CHUNK = 1 << 25
BLOCK_ROWS = 100_000
COMMON = 1 << 17
END = 0xFF  #: never a byte of UTF-8: ends a text, and stands before it
MERGE_ROWS = 1_500_000
_END_TOKEN = np.uint64(1)
_DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}  #: of sorted keys


# --- counts --------------------------------------------------------------------------------


def _padded(offsets: np.ndarray, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with `depth` marks before and one after each text; places to score; first of each text."""
    n, texts = len(data), len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(n + texts * (depth + 1), END, np.uint8)
    shift = np.repeat(np.arange(texts) * (depth + 1) + depth, size)
    out[np.arange(n) + shift] = data
    first = offsets[:-1] + np.arange(texts)
    many = size + 1
    places = np.arange(n + texts) + np.repeat(np.arange(texts) * depth + depth, many)
    return out, places, first


def _grams(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with its context: the byte lowest, then the nearest context byte, and so on."""
    out = data[places].astype(np.uint64)
    for d in range(1, depth + 1):
        out |= data[places - d].astype(np.uint64) << np.uint64(8 * d)
    return out


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the keys asked for, which are all there: each distinct one is searched once, in order."""
    distinct, inverse = np.unique(asked, return_inverse=True)
    return values[np.searchsorted(keys, distinct)][inverse]


class _Counter:
    """Counts of 64-bit keys that are merged when many have come together."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.rows = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.rows += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else by
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts, self.rows = [keys], [counts], len(keys)
        return keys, counts

    def taken(self, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
        """What has come together, if it is more than `limit` rows even when merged."""
        if self.rows <= 2 * limit:
            return None
        out = self.merged()
        if self.rows <= limit:
            return None
        self.keys, self.counts, self.rows = [], [], 0
        return out


def chunked(rows: DataFrame) -> DataFrame:
    """row and chunk numbers, doc_id, held_out and text, stored: later passes see the same chunks."""
    doc_kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        chunk, size = number, 0
        for batch in batches:
            for row, stop, offsets, data in slices(batch.column(1)):
                if size and size + len(data) > CHUNK:
                    chunk, size = chunk + 1, 0
                size += len(data)
                n = stop - row
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(n)),
                        pa.array(np.full(n, chunk)),
                        *[batch.column(i).slice(row, n) for i in (0, 2, 1)],
                    ],
                    ["row", "chunk", "doc_id", "held_out", "text"],
                )
                number += n

    rows = rows.select("doc_id", "text", "held_out")
    return stored(rows.mapInArrow(run, f"row long, chunk long, doc_id {doc_kind}, held_out boolean, text string"), "lm-rows", "zstd")


def corpus_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind (0: byte strings, 1: tokens), chunk, key and count in the training texts, stored. Strings
    are those of all texts of a chunk, a few of them in several rows; tokens have no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = (_Counter(), _Counter())
        chunk = None

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not kind and len(keys):  # the lowest bit tells held-out texts
                counts = np.where(keys & np.uint64(1), 0, counts)
                keys = keys >> np.uint64(1)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, counts = keys[first], np.add.reduceat(counts, first)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), kind, np.int32)),
                        pa.array([None if kind else chunk] * len(part), pa.int64()),
                        pa.array(part),
                        pa.array(counts[at : at + 100_000]),
                    ],
                    ["kind", "chunk", "key", "count"],
                )

        for batch in batches:
            own, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)) if len(own) else []
            for begin, end in zip([0, *ends[:-1]], ends, strict=True) if len(own) else ():
                if chunk is not None and own[begin] != chunk:
                    yield from rows(0, *counters[0].merged())
                    counters = (_Counter(), counters[1])
                chunk = int(own[begin])
                part = batch.column(2).slice(begin, end - begin)
                for row, _, offsets, data in slices(part):
                    data = lowered(data)
                    apart = held[begin + row : begin + row + len(offsets) - 1]
                    padded, places, _ = _padded(offsets, data, depth)
                    mark = np.repeat(apart, np.diff(offsets) + 1).astype(np.uint64)
                    counters[0].add(_grams(padded, places, depth) << np.uint64(1) | mark)
                    words = Words(offsets, data)
                    tokens = words.hashes[~apart[words.doc]] if len(words) else np.zeros(0, np.uint64)
                    counters[1].add(np.append(tokens, np.full(int((~apart).sum()), _END_TOKEN)))
                    for kind, counter in enumerate(counters):
                        if (full := counter.taken(MERGE_ROWS)) is not None:
                            yield from rows(kind, *full)
        for kind, counter in enumerate(counters):
            yield from rows(kind, *counter.merged())

    own = rows.select("chunk", "held_out", "text")
    return stored(own.mapInArrow(run, "kind int, chunk long, key long, count long"), "lm-strings", "zstd", **_DELTAS)


# --- the tree ------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0.5 on, by Stirling's series eight steps up."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - low


def _decisions(counts: np.ndarray) -> np.ndarray:
    """Zeros and ones of the 255 decisions of a byte, from the counts of its 256 values."""
    n = len(counts)
    return np.concatenate([counts.reshape(n, 1 << k, 2, 128 >> k).sum(-1) for k in range(8)], axis=1)


def _log_kt(bits: np.ndarray) -> np.ndarray:
    a, b = bits[..., 0], bits[..., 1]
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1.0)


def _kt_one(bits: np.ndarray) -> np.ndarray:
    return (bits[..., 1] + 0.5) / (bits[..., 0] + bits[..., 1] + 1.0)


@dataclass
class Level:
    """Decisions of the contexts of one depth: context and decision (1 to 255) as one sorted number,
    zeros and ones; of the contexts one deeper the weights' sum, the zeros and ones in the shared leaf,
    and whether any is a context of its own. A context's first decision is always there."""

    depth: int
    id: np.ndarray
    bits: np.ndarray
    deeper: np.ndarray
    left: np.ndarray
    inner: np.ndarray

    def __post_init__(self):
        context = self.id >> np.uint64(8)
        new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.kept = (self.bits[head].sum(axis=1) >= LEAST) | (self.depth == 0)
        inner = self.inner[head]
        kt, split = _log_kt(self.bits), _log_kt(self.left) + self.deeper
        self.weighted = np.where(inner, np.logaddexp(kt, split) - np.log(2), kt)
        self.stop = np.where(inner, np.exp(kt - np.log(2) - self.weighted), 1.0)
        self.one, self.rest = _kt_one(self.bits), _kt_one(self.left)

    @staticmethod
    def deepest(depth: int, keys: np.ndarray, counts: np.ndarray) -> tuple[Level, np.ndarray]:
        """From distinct strings and their counts; also the place of each string's eight decisions."""
        byte = keys & np.uint64(255)
        k = np.arange(8, dtype=np.uint64)
        node = (np.uint64(1) << k) | (byte[:, None] >> (np.uint64(8) - k))
        id, at = np.unique((keys & ~np.uint64(255))[:, None] | node, return_inverse=True)
        at = at.reshape(node.shape)
        bit = (byte[:, None] >> (np.uint64(7) - k)) & np.uint64(1)
        ones = np.bincount(at.ravel(), (bit * counts[:, None].astype(np.uint64)).ravel(), minlength=len(id))
        both = np.bincount(at.ravel(), np.repeat(counts, 8), minlength=len(id))
        none = np.zeros((len(id), 2))
        return Level(depth, id, np.stack([both - ones, ones], axis=1), none[:, 0], none, none[:, 0] > 0), at

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What this gives the contexts one shorter: numbers, sums (zeros, ones, weights, zeros and
        ones of the shared leaf, contexts of their own), and the place of each decision in them."""
        mask = np.uint64((1 << 8 * self.depth) - 1)
        id, at = np.unique(self.id & mask, return_inverse=True)
        kept = self.kept
        parts = [*self.bits.T, np.where(kept, self.weighted, 0.0), *np.where(kept, 0.0, self.bits.T), kept]
        return id, np.stack([np.bincount(at, x, minlength=len(id)) for x in parts], axis=1), at

    @staticmethod
    def of_sums(depth: int, id: np.ndarray, sums: np.ndarray) -> Level:
        return Level(depth, id, sums[:, :2], sums[:, 2], sums[:, 3:5], sums[:, 5] > 0)


def _down(levels: list[tuple[Level, np.ndarray]], state: tuple) -> tuple:
    """Chance of a one mixed so far, weight still open, and chance in the leaf that has it, carried
    down through levels, each with the places of the decisions wanted."""
    mixed, open_, rest = state
    for level, at in levels:
        kept, stop = level.kept[at], level.stop[at]
        mixed = np.where(kept, mixed + open_ * stop * level.one[at], mixed)
        open_, rest = np.where(kept, open_ * (1 - stop), open_), np.where(kept, level.rest[at], rest)
    return mixed, open_, rest


def _subtrees(depth: int, low: int, keys: np.ndarray, counts: np.ndarray) -> tuple[list, tuple]:
    """Levels from `depth` up to `low` with the places of the strings' decisions, and what the last gives."""
    level, at = Level.deepest(depth, keys, counts)
    levels = [(level, at)]
    while True:
        id, sums, up = level.summed()
        if level.depth == low:
            return levels[::-1], (id, sums)
        level, at = Level.of_sums(level.depth - 1, id, sums), up[at]
        levels.append((level, at))


def _crown(depth: int, id: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Numbers of the decisions of `depth` bytes and their chances carried down from the root."""
    level, at = Level.of_sums(depth, id, sums), np.arange(len(id))
    levels = [(level, at)]
    while level.depth:
        id, sums, up = level.summed()
        level, at = Level.of_sums(level.depth - 1, id, sums), up[at]
        levels.append((level, at))
    n = len(levels[0][0].id)
    return levels[0][0].id, _down(levels[::-1], (np.zeros(n), np.ones(n), np.full(n, 0.5)))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts in blocks of about `rows` that do not part a group; groups come in order."""
    kept: list[np.ndarray] = []
    many = 0
    for batch in batches:
        kept.append(np.stack([batch.column(i).to_numpy() for i in range(3)]))
        many += batch.num_rows
        if many < rows:
            continue
        whole = np.concatenate(kept, axis=1)
        end = int(np.searchsorted(whole[0], whole[0, -1], "left"))  # the last group may go on
        if end:
            yield whole[1, :end].view(np.uint64), whole[2, :end]
        kept, many = [whole[:, end:]], whole.shape[1] - end
    if many:
        whole = np.concatenate(kept, axis=1)
        yield whole[1].view(np.uint64), whole[2]


def log_table(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key and log10 of its last byte after the others, for every string of the texts, stored."""
    low = min(LOW, depth)
    counts = stored(strings.groupBy("key").agg(F.sum("count").alias("count")), "lm-counts")
    release(strings.sparkSession)
    group = F.shiftright("key", 8).bitwiseAND((1 << 8 * low) - 1).alias("group")
    own = counts.select(group, "key", "count").repartition("group").sortWithinPartitions("group")
    names = ["zeros", "ones", "deeper", "left_zeros", "left_ones", "inner"]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, many in _blocks(batches, BLOCK_ROWS):
            id, sums = _subtrees(depth, low, keys, many)[1]
            yield pa.RecordBatch.from_arrays([pa.array(id.view(np.int64)), *map(pa.array, sums.T)], ["id", *names])

    sums = own.mapInArrow(up, "id long, " + ", ".join(f"{x} double" for x in names))
    # 255 decisions of each context of `low` - 1 bytes at most
    sums = sums.groupBy("id").agg(*[F.sum(x).alias(x) for x in names]).orderBy("id").toArrow()
    id = sums["id"].to_numpy().view(np.uint64)
    crown = _crown(low - 1, id, np.stack([sums[x].to_numpy() for x in names], axis=1)) if len(id) else None
    shared = strings.sparkSession.sparkContext.broadcast(crown)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << 8 * low) - 1)
        for keys, many in _blocks(batches, BLOCK_ROWS):
            id, state = shared.value
            levels = _subtrees(depth, low, keys, many)[0]
            first, at = levels[0]
            place = np.searchsorted(id, first.id & mask)[at]
            mixed, open_, rest = _down(levels, tuple(x[place] for x in state))
            one = np.clip(mixed + open_ * rest, 1e-12, 1 - 1e-12)
            bit = (keys[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
            logs = np.log10(np.where(bit > 0, one, 1 - one)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(logs.astype(np.float32))], ["key", "logp"])

    out = stored(own.mapInArrow(down, "key long, logp float"), "lm-logs", "zstd")
    discard(counts)
    release(strings.sparkSession)
    return out


# --- scores --------------------------------------------------------------------------------


@dataclass
class WordTable:
    """Common words and their counts; N tokens and V distinct ones in all."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def room(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def common_words(counts: DataFrame, common: int = COMMON) -> WordTable:
    total, distinct = counts.agg(F.sum("count"), F.count("*")).first()
    total = total or 0
    # every such word is one of at most `common`, as together they have no more than all tokens
    table = counts.where(F.col("count") * common >= total).select("key", "count").toArrow()
    keys = table["key"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return WordTable(keys[by], table["count"].to_numpy()[by], total, distinct)


@scoped
def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    rows = narrow(docs, "doc_id", "text")
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    rows = chunked(rows)
    pieces = corpus_counts(rows, depth)
    strings = pieces.where("kind = 0").select("chunk", "key", "count")
    counts = stored(pieces.where("kind = 1").groupBy("key").agg(F.sum("count").alias("count")), "lm-words")
    release(docs.sparkSession)
    words, logs = common_words(counts), log_table(strings, depth)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {doc_kind}, held_out boolean, n_tokens long, n_known long, base double, "
        "score double, n_bytes long, word array<long>, many array<int>"
    )
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(texts: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
        words = shared.value
        by = np.argsort(string := found["key"].to_numpy())
        string, each = string[by].view(np.uint64), found["logp"].to_numpy()[by].astype(np.float64)
        logs = np.log10((words.counts + 0.5) / words.room) if len(words.counts) else np.zeros(1)
        known = words.hashes if len(words.hashes) else np.zeros(1, np.uint64)
        real = len(words.hashes) > 0
        end = int(np.searchsorted(known, _END_TOKEN))
        end_known = real and known[min(end, len(known) - 1)] == _END_TOKEN
        for batch in texts.to_batches():
            for row, stop, offsets, data in slices(batch.column(4)):
                data = lowered(data)
                padded, places, starts = _padded(offsets, data, depth)
                logp = _looked_up(string, each, _grams(padded, places, depth))
                own = Words(offsets, data)
                n = stop - row
                value, inverse, many = np.unique(own.hashes, return_inverse=True, return_counts=True)
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = (known[at] == value) & real
                common = hit[inverse]
                base = np.bincount(own.doc, np.where(common, logs[at][inverse], 0.0), minlength=n)[:n]
                n_known = np.bincount(own.doc[common], minlength=n)[:n]
                if end_known:
                    base, n_known = base + logs[end], n_known + 1
                rare = np.flatnonzero(~common)
                doc, key = own.doc[rare], own.hashes[rare]
                if not end_known:  # too few texts for the end to be common: it is joined as a rare word
                    doc = np.append(doc, np.arange(n))
                    key = np.append(key, np.full(n, _END_TOKEN))
                by = np.lexsort((key, doc))
                doc, key = doc[by], key[by]
                first = np.flatnonzero(
                    np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])[: len(doc)]
                )
                times = np.diff(np.append(first, len(doc))).astype(np.int32)
                doc, key = doc[first], key[first]
                lists = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(row, n) for i in (0, 2, 3)],
                        pa.array(np.diff(own.first) + 1),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base),
                        pa.array(np.add.reduceat(logp, starts)),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(key.view(np.int64))).cast(longs),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(times)).cast(ints),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "word", "many"],
                )

    def of_chunk(texts: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(texts, found))

    found = strings.select("chunk", "key").join(logs, "key").select("chunk", "key", "logp")
    found = stored(found, "lm-found", "zstd")
    discard(pieces, logs)
    release(docs.sparkSession)
    both = rows.groupBy("chunk").cogroup(found.groupBy("chunk"))
    first = stored(both.applyInArrow(of_chunk, schema), "lm-texts")
    discard(rows, found)
    release(docs.sparkSession)
    floor = float(np.log10(0.5 / words.room))
    room = float(words.room)
    pieces = first.select("row", F.explode(F.arrays_zip("word", "many")).alias("w"))
    pieces = pieces.select("row", F.col("w.word").alias("key"), F.col("w.many").alias("many"))
    rare = counts.where(F.col("count") * COMMON < words.tokens).select("key", "count")
    sums = pieces.join(rare, "key", "left").groupBy("row").agg(
        F.sum(F.col("many") * F.coalesce(F.log10((F.col("count") + 0.5) / room), F.lit(floor))).alias("more"),
        F.sum(F.when(F.col("count").isNotNull(), F.col("many")).otherwise(0)).alias("found"),
    )
    return first.drop("word", "many").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / (F.log10(F.lit(2.0)) * (F.col("n_bytes") + 1))).alias("bits_per_byte"),
    )
