"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size: class c holds those of 2^c to 2^(c+1) - 1 distinct 5-word shingles.
For each class a document is cut into windows of 2^(c+2) shingles that overlap by half, so that a
passage as long as any item of the class lies within one window and makes up a good part of it.
Window and item get a one-permutation MinHash of 32 bins (an item's shingle is the least of
its bin in the window with the odds of their Jaccard similarity); a bin with equal values makes a
candidate. What that misses by chance is found exactly: an item of n shingles of which m have to be
found has n - m + 1 that cannot all be absent, so the least n - m + 1 are looked up in every text.
An item of one to four words is one run of so many words, looked up as such. Candidates are
verified exactly: the share of the item's distinct shingles that occur anywhere in the document has
to reach `CONTAINMENT`.

Items are shingled and signed by tasks and stored, however many they are. What travels to the
documents are filters of the items' values and shingles, of bounded size. A document that meets one
becomes a row with the values and shingles that passed; those rows, and no whole texts, are
joined with the items. Documents are read once.

Words are runs of anything but the space and the characters 9 to 13, in lower case. Defined results:
NULL and empty texts, and items without words, match nothing; a NULL id is reported as it is;
repeated documents are each reported, repeated items each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.llm.common import KeyFilter, Words, key_filter, narrow, slices, stored
from qagrade.sources.scratch import scoped

SHINGLE = 5
CONTAINMENT = 0.8
BINS_LOG2 = 5
#: Kinds of values beside the size classes: an exact look-up, and runs of k words as -10 - k.
LEAST, RUN = -1, -10


def size_class(n: int) -> int:
    return max(int(n).bit_length() - 1, 0)


def minima(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): the least hash of every bin of every row; bins are the top bits."""
    windows = np.sort(windows, axis=1)
    bins = windows >> np.uint64(64 - BINS_LOG2)
    first = np.ones(windows.shape, bool)
    first[:, 1:] = bins[:, 1:] != bins[:, :-1]
    row, column = np.nonzero(first)
    return row, windows[row, column]


def _half_windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) rows of `size` shingles, stepping by half; a text's end repeats its last one."""
    step = size // 2
    n = np.diff(first)
    windows = np.where(n > 0, np.maximum(-(-n // step) - 1, 1), 0)
    text = np.repeat(np.arange(len(n)), windows)
    number = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (first[text] + number * step)[:, None] + np.arange(size)
    return text, hashes[np.minimum(at, first[text + 1][:, None] - 1)]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *[r.view(np.int64) for r in rows]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


# --- items -------------------------------------------------------------------------------------


def signed_items(benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item, item_id, shingles, and the kinds and values that make candidates, of every item with words, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, offsets, data in slices(pc.utf8_lower(batch.column(2))):
                words = Words(offsets, data)
                rows, sets, kinds, values = [], [], [], []
                for k in range(1, SHINGLE + 1):
                    at, hashes = words.windows(k)
                    first = np.searchsorted(at, words.first, "left")
                    n = np.diff(words.first)
                    for i in np.flatnonzero(n >= k if k == SHINGLE else n == k):
                        own = np.unique(hashes[first[i] : first[i + 1]])
                        if k < SHINGLE:
                            kind, value = np.array([RUN - k]), own
                        else:
                            signature = minima(own[None, :])[1]
                            least = own[: len(own) - int(np.ceil(containment * len(own) - 1e-9)) + 1]
                            kind = np.repeat([size_class(len(own)), LEAST], [len(signature), len(least)])
                            value = np.concatenate([signature, least])
                        rows.append(row + i)
                        sets.append(own)
                        kinds.append(kind.astype(np.int64))
                        values.append(value)
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), _lists(sets), _lists(kinds), _lists(values)],
                    ["item", "item_id", "shingles", "kinds", "values"],
                )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = narrow(benchmark, "item_id", "text").select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return stored(rows.mapInArrow(run, f"item long, item_id {kind}, shingles array<long>, kinds array<long>, values array<long>"), "items")


# --- documents -----------------------------------------------------------------------------------


def _size_of(kind: int) -> int:
    """Words of the shingles of a kind."""
    return RUN - kind if kind < RUN else SHINGLE


def _values(words: Words, windows: dict, kinds: list[int], filter_: KeyFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, value) of what passes the filter of values."""
    texts, found, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for kind in kinds:
        at, own = windows[_size_of(kind)]
        if not len(own):
            continue
        text = words.doc[at]
        if kind >= 0:
            text, rows = _half_windows(own, np.searchsorted(at, words.first, "left"), 4 << kind)
            row, own = minima(rows)
            text = text[row]
        good = filter_.passes(own)
        texts.append(text[good])
        values.append(own[good])
        found.append(np.full(int(good.sum()), kind))
    return np.concatenate(texts), np.concatenate(found), np.concatenate(values)


def _hits(docs: DataFrame, kinds: list[int], values: KeyFilter, shingles: KeyFilter) -> DataFrame:
    """hit, doc_id, text_hash, shingles that may be an item's, and the kinds and values that may
    be a signature's, of every document that has any, stored."""
    shared = docs.sparkSession.sparkContext.broadcast((values, shingles))
    sizes = sorted({_size_of(kind) for kind in kinds})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_value, by_shingle = shared.value
        for batch in batches:
            for row, end, offsets, data in slices(pc.utf8_lower(batch.column(3))):
                words = Words(offsets, data)
                windows = {k: words.windows(k) for k in sizes}
                text, kind, value = _values(words, windows, kinds, by_value)
                if not len(text):
                    continue
                of_text: list[list[np.ndarray]] = [[] for _ in range(end - row)]
                for at, hashes in windows.values():
                    good = np.flatnonzero(by_shingle.passes(hashes)) if len(hashes) else np.zeros(0, np.int64)
                    for i in np.unique(words.doc[at[good]]):
                        of_text[i].append(hashes[good[words.doc[at[good]] == i]])
                rows, sets, own_kinds, own_values = [], [], [], []
                by = np.lexsort((value, kind, text))
                text, kind, value = text[by], kind[by], value[by]
                new = np.ones(len(by), bool)
                new[1:] = (text[1:] != text[:-1]) | (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])
                text, kind, value = text[new], kind[new], value[new]
                for i in np.unique(text):
                    a, b = np.searchsorted(text, [i, i + 1])
                    rows.append(row + i)
                    sets.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *of_text[i]])))
                    own_kinds.append(kind[a:b])
                    own_values.append(value[a:b])
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(own) for c in range(3)], _lists(sets), _lists(own_kinds), _lists(own_values)],
                    ["hit", "doc_id", "text_hash", "shingles", "kinds", "values"],
                )

    doc = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("hit"), "doc_id", _text_hash().alias("text_hash"), "text")
    schema = f"hit long, doc_id {doc}, text_hash long, shingles array<long>, kinds array<long>, values array<long>"
    return stored(rows.mapInArrow(run, schema), "hits")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _found(docs: DataFrame, benchmark: DataFrame, containment: float) -> DataFrame:
    """doc_id, text_hash, item_id, n_item, n_shared of every pair that reaches the containment, stored."""
    items = signed_items(benchmark, containment)
    keys = items.select("item", F.explode(F.arrays_zip("kinds", "values")).alias("x")).select("item", "x.kinds", F.col("x.values").alias("key"))
    kinds = sorted(r[0] for r in keys.select("kinds").distinct().collect())  # one a size class
    filters = key_filter(keys), key_filter(items.select(F.explode("shingles").alias("key")))
    hits = _hits(narrow(docs, "doc_id", "text"), kinds, *filters)
    met = hits.select("hit", F.explode(F.arrays_zip("kinds", "values")).alias("x")).select("hit", "x.kinds", F.col("x.values").alias("key"))
    pairs = stored(met.join(keys, ["kinds", "key"]).select("hit", "item").distinct(), "pairs")
    own = items.select("item", "item_id", F.col("shingles").alias("wanted"))
    rows = pairs.join(hits.select("hit", "doc_id", "text_hash", "shingles"), "hit").join(own, "item")
    shared = F.size(F.array_intersect("wanted", "shingles")).cast("long")
    rows = rows.select("doc_id", "text_hash", "item_id", F.size("wanted").cast("long").alias("n_item"), shared.alias("n_shared"))
    return stored(rows.where(F.col("n_shared") >= containment * F.col("n_item")), "found")


@scoped
def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, shingles of the item, those found in the document, and their share, for
    every document and item whose share reaches `containment`."""
    share = F.col("n_shared") / F.col("n_item")
    return _found(docs, benchmark, containment).select("doc_id", "item_id", "n_item", "n_shared", share.alias("containment"))


@scoped
def decontaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of `docs`, with all columns, whose texts hold no test item."""
    found = _found(docs, benchmark, containment)
    gone = stored(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_hash() == F.col("_hash"))
    return docs.join(gone, same, "left_anti").select(docs.columns)
