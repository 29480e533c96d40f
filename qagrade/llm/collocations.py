"""Phrases whose words belong together, by prefix-free parsing of the texts.

Each piece of a text is cut into chunks wherever a word's hash says so, so equal stretches are cut
equally wherever they stand. A chunk goes on for three words beyond its end, the first ones of the
next chunk, and so holds every phrase of up to four words that starts in it; phrases that start in
those three words are the next chunk's, so each occurrence is counted once. The distinct chunks of
a language are a dictionary with the number of their occurrences, the parse. Phrases are counted in
the dictionary alone, weighted: a passage in a million documents is counted like one in a single one.

Counts go up by length. A phrase that is frequent enough consists of two shorter ones that are, so
only those are counted whose parts pass a filter of the frequent phrases one word shorter. The
filters are bitmaps of a bounded size; they only spare work, no frequent phrase can fail them.
Phrases are counted by 64-bit hashes of language and words, summed in tasks and combined before the
shuffle. Each frequent phrase is given one part of the dictionary that has it; its text is read there
alone, so the texts read grow with the phrases and not with the tasks. All that follows,
cuts, scores, drops and ranks, is joins on them. A language's best phrases are chosen in slices
of its phrases first, so no task sees all of a language.

Defined results: NULL texts have no words; a NULL language is `und`, together with a language of that
name; ids do not matter and repeated rows count as often as they stand; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qagrade.llm.common import KeyFilter, Words, _splitmix, key_filter, lowered, narrow, slices, span_hashes, stored, window_hashes
from qagrade.sources.scratch import scoped

LONGEST = 4
LEAST = 30
INSIDE_PERCENT = 80
BEST = 2000
SCALE = 2_000_000
#: One word in so many cuts a piece.
TRIGGER = 32
_HELD = 1 << 20  #: counts that a task keeps before it sends them on
_RANK_SLICES = 64
_TURNS = 256

_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + [10, 11, 12, 13])
_BLANK = _ENDS | np.isin(np.arange(256), [32, 9])
_ONLY_SPACE = np.arange(256) == 32
_U = np.uint64


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Of each run of words first to last (exclusive): its words, joined by spaces, as a string."""
    many = last - first
    word = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    length = end[word] - start[word] + 1
    stop = np.cumsum(length)
    at = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length - start[word], length)
    out = np.append(data, 32).astype(np.uint8)[np.minimum(at, len(data))]
    out[stop - 1] = 32
    ends = np.append(0, stop)[np.append(0, np.cumsum(many))]
    # the space after a run's last word belongs to no string: it is dropped with a mask
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    offsets = ends - np.arange(len(ends))
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[keep].tobytes()))


def chunks(offsets: np.ndarray, data: np.ndarray, trigger: int = TRIGGER) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text number, words and own length (without the overlap) of every chunk of a slice."""
    words = Words(offsets, data, _BLANK)
    n = len(words)
    ends = np.append(0, np.cumsum(_ENDS[data]))
    piece = ends[words.start] if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (piece[1:] != piece[:-1]) | (words.doc[1:] != words.doc[:-1])
    pieces = np.flatnonzero(new)
    cut = np.flatnonzero(new | (words.hashes % _U(trigger) == 0))
    stop = np.append(cut[1:], n)[: len(cut)]
    of_piece = np.append(pieces[1:], n)[np.searchsorted(pieces, cut, "right") - 1] if n else stop
    last = np.minimum(stop + LONGEST - 1, of_piece)
    return words.doc[cut], _gathered(data, words.start, words.end, cut, last), stop - cut


def _dictionary(docs: DataFrame, trigger: int) -> DataFrame:
    """lang, chunk, own (words that are its own), many (occurrences) and part of all texts, stored. A
    part is what one task has written."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, offsets, data in slices(batch.column(1)):
                doc, chunk, own = chunks(offsets, lowered(data), trigger)
                lang = batch.column(0).take(pa.array(row + doc))
                for a in range(0, len(own), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [lang.slice(a, 50_000), chunk.slice(a, 50_000), pa.array(own[a : a + 50_000].astype(np.int32))],
                        ["lang", "chunk", "own"],
                    )

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(parse, "lang string, chunk string, own int")
    found = rows.groupBy("lang", "chunk", "own").agg(F.count("*").alias("many"))
    return stored(found.withColumn("part", F.spark_partition_id()), "chunks", compression="zstd")


class _Chunks:
    """Words of a slice of the dictionary, and keys of its phrases."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lang: np.ndarray, own: np.ndarray):
        self.words = Words(offsets, data, _ONLY_SPACE)
        doc = self.words.doc
        self.lang = lang[doc]
        #: Whether a phrase that starts at the word is the chunk's own.
        self.own = np.arange(len(doc)) - self.words.first[doc] < own[doc]

    def keys(self, n: int) -> np.ndarray:
        """Key of the phrase of `n` words at each word but the last n - 1; its language is that of the first."""
        hashes = window_hashes(self.words.hashes, n)
        with np.errstate(over="ignore"):
            return _splitmix(hashes ^ self.lang[: len(hashes)])

    def starts(self, n: int, filter_: KeyFilter | None) -> tuple[np.ndarray, np.ndarray]:
        """Words at which an own phrase of `n` words starts whose parts pass the filter, and its key."""
        doc = self.words.doc
        at = len(doc) - n + 1
        if at <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        good = self.own[:at] & (doc[:at] == doc[n - 1 :])
        if filter_ is not None:
            passed = filter_.passes(self.keys(n - 1))
            good &= passed[:-1] & passed[1:]
        start = np.flatnonzero(good)
        return start, self.keys(n)[start]


def _slices_of(batch: pa.RecordBatch) -> Iterator[tuple[_Chunks, int, int]]:
    """The slices of a batch of the dictionary (lang, chunk, own, many)."""
    lang = batch.column(0).dictionary_encode()
    names = [x.encode() for x in lang.dictionary.to_pylist()]
    ends = np.cumsum([0, *map(len, names)])
    data = np.frombuffer(b"".join(names), np.uint8)
    hashed = span_hashes(data, ends[:-1], ends[1:])[lang.indices.to_numpy()]
    own = batch.column(2).to_numpy()
    for row, end, offsets, data in slices(batch.column(1)):
        yield _Chunks(offsets, data, hashed[row:end], own[row:end]), row, end


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts and one of their parts."""
    key, count, part = np.concatenate(keys), np.concatenate(counts), np.concatenate(parts)
    by = np.argsort(key, kind="stable")
    key, count = key[by], count[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count, part[by[first]]


def _frequent(dictionary: DataFrame, n: int, shared, least: int) -> DataFrame:
    """key, count and one part of the phrases of `n` words that occur `least` times, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            many, part = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for own, row, _ in _slices_of(batch):
                start, key = own.starts(n, shared.value if shared else None)
                at = row + own.words.doc[start]
                held.append((key, many[at], part[at]))
            if sum(len(key) for key, *_ in held) > 2 * _HELD:
                held = [_summed(*zip(*held, strict=True))]
                if len(held[0][0]) > _HELD:
                    yield from _rows(*held[0])
                    held = []
        if held:
            yield from _rows(*_summed(*zip(*held, strict=True)))

    found = dictionary.mapInArrow(count, "key long, f long, part int")
    # the least part by an order that differs by the key's last bits: no part has most phrases
    turn = F.col("key").bitwiseAND(F.lit(_TURNS - 1)).cast("int")
    found = found.groupBy("key").agg(F.sum("f").alias("f"), F.min(F.col("part").bitwiseXOR(turn)).alias("part"))
    return stored(found.where(F.col("f") >= least).withColumn("part", F.col("part").bitwiseXOR(turn)), f"frequent-{n}")


def _rows(key: np.ndarray, total: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 100_000):
        own = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[own].view(np.int64)), pa.array(total[own].astype(np.int64)), pa.array(part[own].astype(np.int32))],
            ["key", "f", "part"],
        )


def _of_part() -> Column:
    """A number of each part, which marks a key as one of that part."""
    return F.xxhash64("part")


def _texts(dictionary: DataFrame, filters: list, chosen) -> DataFrame:
    """key, words, lang and phrase of all phrases whose key and part pass the filter `chosen`, at least once
    a task that reads from the part; `filters` are those of the phrases by length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, _U) for _ in range(len(filters) + 1)]
        for batch in batches:
            marks = batch.column(4).to_numpy().view(_U)
            for own, row, _ in _slices_of(batch):
                for n in range(1, len(seen) + 1):
                    start, key = own.starts(n, filters[n - 2].value if n > 1 else None)
                    good = chosen.value.passes(key ^ marks[row + own.words.doc[start]])
                    key, at = np.unique(key[good], return_index=True)
                    new = np.isin(key, seen[n - 1], assume_unique=True, invert=True)
                    key, start = key[new], start[good][at[new]]
                    if not len(key):
                        continue
                    kept = seen[n - 1] if len(seen[n - 1]) < _HELD else seen[n - 1][:0]
                    seen[n - 1] = np.concatenate([kept, key])
                    words = own.words
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(np.full(len(key), n, np.int32)),
                            batch.column(0).take(pa.array(row + words.doc[start])),
                            _gathered(words.data, words.start, words.end, start, start + n),
                        ],
                        ["key", "words", "lang", "phrase"],
                    )

    rows = dictionary.withColumn("part", _of_part())
    return rows.mapInArrow(read, "key long, words int, lang string, phrase string")


@scoped
def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """lang, words, phrase, f and n of every phrase of up to `longest` words that occurs `least`
    times in a language; n is the number of all words of the language."""
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have up to {LONGEST} words")
    context = docs.sparkSession.sparkContext
    dictionary = _dictionary(narrow(docs, "lang", "text"), trigger)
    counts, filters = [], []
    for n in range(1, longest + 1):
        if counts:
            filters.append(context.broadcast(key_filter(counts[-1])))
        counts.append(_frequent(dictionary, n, filters[-1] if filters else None, least))
    keyed = counts[0].withColumn("words", F.lit(1))
    for n, found in enumerate(counts[1:], 2):
        keyed = keyed.unionByName(found.withColumn("words", F.lit(n)))
    chosen = context.broadcast(key_filter(keyed.select(F.col("key").bitwiseXOR(_of_part()).alias("key"))))
    named = _texts(dictionary, filters, chosen).distinct().join(keyed.drop("part"), ["key", "words"])
    total = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("many")).alias("n"))
    return stored(named.join(total, "lang").select("lang", "words", "phrase", "f", "n"), "phrases")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """Share of the phrase in its parts, in whole millionths of the mean part; exact for any counts."""
    return F.call_function("div", _exact(a) * F.lit(SCALE), _exact(left) + _exact(right)).cast("bigint")


@scoped
def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, trigger: int = TRIGGER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `best` phrases.

    a is how often the phrase occurs; l and r are the counts of its parts at the cut that scores
    least; n is the number of the language's words.
    """
    known = frequent_phrases(docs, least, trigger=trigger)
    phrases = known.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), "n", F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "n", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns(
        {"left": _part(F.col("w"), F.lit(1), F.col("k")), "right": _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k"))}
    ).drop("w")
    # every part of a frequent phrase is frequent itself
    part = lambda side, f: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "n", "cut.*").drop("k")
    # all shorter phrases inside longer ones, with the longer one's count
    spans = [(start, length) for size in range(3, LONGEST + 1) for length in range(2, size) for start in range(1, size - length + 2)]
    inner = [
        F.when(F.col("words") >= start + length - 1, F.when(F.col("words") > length, _part(F.col("w"), F.lit(start), F.lit(length))))
        for start, length in sorted(set(spans))
    ]
    covers = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(F.array(*inner))).alias("phrase"), "a")
    covers = covers.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(_exact(F.col("longer")) * 100 >= _exact(F.col("a")) * INSIDE_PERCENT, F.lit(False))
    left = scored.join(covers, ["lang", "phrase"], "left").where(~covered)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_RANK_SLICES))).orderBy(*order)
    first = left.withColumn("rank", F.row_number().over(part_of)).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
