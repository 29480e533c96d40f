"""Substring deduplication over bytes by a difference-cover suffix sort.

Equal strings of `MATCH` bytes have equal anchors, so only the surroundings of anchors that
several documents have can hold them. Anchors have `ANCHOR` bytes: shorter ones are equal by chance
the more often the more texts there are, and their contexts would outgrow the input. An anchor's context is what strings of `MATCH` bytes over
it can reach. Occurrences of equal contexts are combined into their least document; every other
document loses the whole context. What is left to tell is whether strings of one context also
stand in another context of the same anchor, and that is what the suffixes are sorted for.

The contexts of an anchor are dealt to one task, very frequent anchors over several. There the
suffixes are sorted by a difference cover: places are numbered in blocks of eight bytes, blocks
1 and 2 of every three are the sample; sampled triples of blocks are sorted and named, the names
of neighbouring triples are sorted again, and so rank the sampled suffixes by `MATCH` bytes and
more; the remaining suffixes are ordered by their first block and the rank behind it and merged
with the sample by the blocks up to a place where both are ranked. Neighbours with an equal
prefix of `MATCH` bytes form one string. The least documents of the strings of an anchor that
several tasks share are combined by the strings' hashes.

A byte is removed if a string of `MATCH` bytes over it also starts in a document with a smaller
id. Defined results: NULL and empty texts have no bytes; rows with a NULL id keep all and count
for no other; rows of equal ids do not remove from each other; an exact copy of a smaller id's
text loses everything if it has `MATCH` bytes. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from qagrade.llm.anchors import copies, freed, release, running, shared_anchors
from qagrade.llm.common import _splitmix, discard, narrow, random_words, slices, span_hashes, stored
from qagrade.sources.scratch import scoped

MATCH = 50
ANCHOR = 30  #: bytes: so many are rarely equal by chance, however many texts there are
BEFORE = MATCH - ANCHOR  #: bytes of a context before its anchor
MARK = ANCHOR % (BEFORE + 1)  #: bytes that choose an anchor
GROUP = 4096  #: contexts of an anchor in one task
CHUNK = 2048  #: contexts sorted at once, whole groups: small enough for a processor's cache
BLOCK = 8
PIECE = 7  #: places of a string's anchor that one screened piece stands for
_BYTE = random_words(256, 3)


#: Of the place of a string's least mark: that of its anchor.
_PLACE = np.arange(MATCH - MARK + 1) % (BEFORE + 1)


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on."""
    with np.errstate(over="ignore"):
        span, factor, part = 1, 0x9E3779B97F4A7C15 | 1, _BYTE[data]
        out = None
        while True:
            if size & span:  # what precedes, and `span` bytes more
                done = size & span - 1
                out = part if out is None else out[:-span] * np.uint64(factor) + part[done:]
            if span * 2 > size:
                return _splitmix(out)
            part = part[:-span] * np.uint64(factor) + part[span:]
            span, factor = span * 2, factor * factor & 0xFFFFFFFFFFFFFFFF


def find_anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, byte and hash of the anchors of a slice.

    A string of MATCH bytes has the anchor that the place of its least mark tells, the first of equal
    ones: of that place the remainder by the number of places that an anchor can have. So strings of
    ANCHOR bytes are chosen by much shorter ones, which makes them fewer than if they were compared
    themselves (a mod-minimizer; ANCHOR and MARK differ by a multiple of those places).
    """
    if len(data) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marks = _rolled(data, MARK)
    held = marks >> np.uint64(32) << np.uint64(32) | np.arange(len(marks), dtype=np.uint64)
    least = running(np.minimum, held, MATCH - MARK + 1).astype(np.uint32).astype(np.int64)
    inside = np.ones(len(least), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[max(a, b - MATCH + 1) : b] = False
    start = np.arange(len(least))
    chosen = np.zeros(len(data), bool)
    chosen[(start + _PLACE[least - start])[inside]] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(offsets, at, "right") - 1
    return doc, at - offsets[doc], _rolled(data, ANCHOR)[at]


def _context_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return span_hashes(data, start, end) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _context_columns(offsets: np.ndarray, data: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of anchors: the hash of the context, its place, the place of the anchor in it, its size."""
    place = at + offsets[doc]
    start, end = np.maximum(place - BEFORE, offsets[doc]), np.minimum(place + MATCH, offsets[doc + 1])
    ctx = _context_hashes(data, start, end, place - start)
    sizes = (start - offsets[doc], place - start, end - start)
    return [ctx.view(np.int64), *[x.astype(np.int32) for x in sizes]]


def _with_bytes(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The contexts with the bytes that their source has there."""
    fields = ["group", "key", "ctx", "start", "before", "size", "parts"]
    wanted = contexts.groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct(*fields)).alias("c"))  # of one text
    rows = docs.join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for row, stop, offsets, data in slices(batch.column(1)):
                own = lists.slice(row, stop - row)
                doc = np.repeat(np.arange(stop - row), own.value_lengths().to_numpy())
                flat = own.flatten()
                part = {f: flat.field(f).to_numpy() for f in fields}
                start = part["start"] + offsets[doc]
                end = start + part["size"]
                ok = np.flatnonzero(end <= offsets[doc + 1])
                held = _context_hashes(data, start[ok], end[ok], part["before"][ok].astype(np.int64))
                ok = ok[held == part["ctx"][ok].view(np.uint64)]  # rows of one id can differ
                raw = data.tobytes()
                for o in np.array_split(ok, len(ok) // 50_000 + 1):
                    texts = [raw[a:b] for a, b in zip(start[o].tolist(), end[o].tolist(), strict=True)]
                    columns = [pa.array(part[f][o]) for f in ("group", "key", "ctx", "before", "parts")]
                    lo = batch.column(0).take(pa.array(row + doc[o]))
                    yield pa.RecordBatch.from_arrays(
                        [*columns, lo, pa.array(texts, pa.binary())], ["group", "key", "ctx", "before", "parts", "lo", "bytes"]
                    )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"group long, key long, ctx long, before int, parts int, lo {doc}, bytes binary")


# --- the sort ------------------------------------------------------------------------------


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of numbers."""
    bits = len(key).bit_length()
    if len(key) and 0 <= key.min() and int(key.max()) < 1 << 63 - bits:
        # sorting numbers that hold their places is several times faster than sorting places
        s = np.sort(key.astype(np.int64) << bits | np.arange(len(key)))
        order, s = s & (1 << bits) - 1, s >> bits
    else:
        order = np.argsort(key)
        s = key[order]
    new = np.zeros(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _named(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples, given by their parts from the first to the last. Sorts of single numbers
    are several times faster than those of tuples, so parts are put together as far as 62 bits hold them."""
    if len(keys) == 1 or not len(keys[0]):
        return _ranks(keys[0])
    out, room = np.zeros(len(keys[0]), np.int64), 1
    for key in keys:
        if key.min() < 0 or key.max() >= 1 << 31:
            key = _ranks(key)
        size = int(key.max()) + 1
        if room * size >= 1 << 62:
            out = _ranks(out)
            room = int(out.max()) + 1
        out, room = out * size + key.astype(np.int64), room * size
    return _ranks(out)


def _merge_places(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many of `right` precede each of `left`, and of `left` each of `right` (ties: left first)."""
    both = _named(*[np.concatenate(x) for x in zip(left, right, strict=True)])
    a, b = both[: len(left[0])], both[len(left[0]) :]
    less = lambda x: np.append(0, np.cumsum(np.bincount(x, minlength=len(both) + 1)))
    return less(b)[a], less(a)[b + 1]


def sorted_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of MATCH bytes in suffix order: text, place, and a number for equal strings.

    The names cover texts of 96 bytes at most.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts])
    width = max(int(size.max()), MATCH)
    wide = width + BLOCK
    flat = b"".join(t.ljust(wide, b"\0") for t in texts)
    blocks = np.ndarray((n, width), ">u8", flat, strides=(wide, 1)).astype(np.uint64)  # eight bytes from each place on
    # their ranks, that of nothing 0, as it is past the end
    block = np.zeros((n, width + 2 * BLOCK), np.int64)
    block[:, :width] = _ranks(blocks.ravel()).reshape(n, -1) + (blocks.min() > 0)
    last = width - MATCH + 2 * BLOCK  # the furthest place whose rank is asked for
    columns = np.arange(width)
    sample = columns[columns // BLOCK % 3 != 0]
    names = np.zeros((n, last + 9 * BLOCK + 1), np.int64)
    triples = [block[:, sample + k * BLOCK].ravel() for k in range(3)]
    own = _named(*triples)  # sorted triples, that of nothing 0
    nothing = ((triples[0] | triples[1] | triples[2]) == 0).any()
    names[:, sample] = (own if nothing else own + 1).reshape(n, -1)
    # the names of four neighbouring triples cover all of a suffix
    ranked = sample[sample <= last]
    rank = np.zeros((n, last + 1), np.int64)
    rank[:, ranked] = _named(*[names[:, ranked + 3 * k * BLOCK].ravel() for k in range(4)]).reshape(n, -1)

    row, at = np.nonzero(np.arange(width - MATCH + 1)[None, :] + MATCH <= size[:, None])
    kind = at // BLOCK % 3
    parts = [np.flatnonzero(kind == k) for k in range(3)]
    first = lambda x, d: block.take((row * block.shape[1] + at + d * BLOCK)[x])
    ranks = lambda x, d: rank.take((row * rank.shape[1] + at + d * BLOCK)[x])
    rest, one, two = parts
    # order inside each part, then the places of the parts among each other
    inside = [_named(first(rest, 0), ranks(rest, 1)), ranks(one, 0), ranks(two, 0)]
    place = np.zeros(len(row), np.int64)
    for part, own in zip(parts, inside, strict=True):
        # equal suffixes in order of their texts
        place[part] = _ranks(own * len(part) + np.arange(len(part)))
    a, b = _merge_places([ranks(one, 0)], [ranks(two, 0)])
    place[one] += a
    place[two] += b
    a, b = _merge_places([first(rest, 0), ranks(rest, 1)], [first(one, 0), ranks(one, 1)])
    place[rest] += a
    place[one] += b
    a, b = _merge_places([first(rest, 0), first(rest, 1), ranks(rest, 2)], [first(two, 0), first(two, 1), ranks(two, 2)])
    place[rest] += a
    place[two] += b
    order = np.empty(len(row), np.int64)
    order[place] = np.arange(len(row))
    row, at = row[order], at[order]
    new = np.zeros(len(row), bool)  # where neighbours' prefixes differ
    begin = row * block.shape[1] + at
    for d in (*range(0, MATCH - BLOCK, BLOCK), MATCH - BLOCK):
        value = block.take(begin + d)
        new[1:] |= value[1:] != value[:-1]
    return row, at, np.cumsum(new)


def _screened(start: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Which contexts share the anchor and some bytes around it with another one. A string of MATCH
    bytes over an anchor has all of the bytes of one of the PIECES there."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin = offsets - offsets[0]
    anchor = begin[:-1] + start
    before = np.arange(0, start.max(initial=0) + 1, PIECE)[:, None]
    a, b = anchor - before, anchor - before + MATCH - PIECE + 1
    piece, found = np.nonzero((a >= begin[:-1]) & (b <= begin[1:]))
    value = span_hashes(data, a[piece, found], b[piece, found]) ^ piece.astype(np.uint64)
    number = _ranks(value)
    out = np.zeros(len(texts), bool)
    out[found[np.bincount(number)[number] > 1]] = True
    return out


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), len(values))


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _compared(contexts: DataFrame) -> DataFrame:
    """ctx and the places of its strings that a smaller document has. For an anchor of several tasks
    each distinct string of a task is a row instead, with its hash, its least document there, and
    the contexts, their documents and the places at which it stands."""
    doc = contexts.schema["lo"].dataType
    kind = to_arrow_type(doc)
    schema = pa.schema(
        [("ctx", pa.int64()), ("strings", pa.list_(pa.int32())), ("hash", pa.binary()), ("lo", kind),
         ("contexts", pa.list_(pa.int64())), ("owners", pa.list_(kind)), ("places", pa.list_(pa.int32()))]
    )

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        held = table["bytes"].combine_chunks()
        parts = table["parts"].to_numpy()
        keep = np.flatnonzero(_screened(table["before"].to_numpy(), held) | (parts > 1))
        if len(keep) == 0:
            return
        texts = held.to_pylist()
        row, at, number = sorted_strings([texts[i] for i in keep])
        row = keep[row]
        docs = table["lo"].to_numpy()[row]
        bounds = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        least = np.repeat(np.minimum.reduceat(docs, bounds), np.diff(np.append(bounds, len(docs))))
        ctx = table["ctx"].to_numpy()[row]
        shared = parts[row] > 1
        gone = np.flatnonzero((least < docs) & ~shared)
        gone = gone[np.argsort(row[gone], kind="stable")]
        ends = _runs(row[gone])
        yield _rows(ctx=pa.array(ctx[gone[ends[:-1]]]), strings=_lists(ends, pa.array(at[gone].astype(np.int32))))
        # a string of an anchor that several tasks have is one row with all its places here
        out = np.flatnonzero(shared)
        ends = _runs(number[out])
        for i in range(0, len(ends) - 1, 50_000):
            own = ends[i : i + 50_001]
            places = out[own[0] : own[-1]]
            first = out[own[:-1]]
            hashes = [
                hashlib.blake2b(texts[r][p : p + MATCH], digest_size=16).digest()
                for r, p in zip(row[first].tolist(), at[first].tolist(), strict=True)
            ]
            own = own - own[0]
            yield _rows(
                hash=pa.array(hashes, pa.binary()),
                lo=pa.array(least[first]),
                contexts=_lists(own, pa.array(ctx[places])),
                owners=_lists(own, pa.array(docs[places])),
                places=_lists(own, pa.array(at[places].astype(np.int32))),
            )

    def _rows(**columns: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                # a chunk ends between groups; no group is larger than about GROUP
                groups = batch.column(0).to_numpy()
                if rows >= CHUNK:
                    same = int(np.argmax(groups != last)) if (groups != last).any() else len(groups)
                    held.append(batch.slice(0, same))
                    rows += same
                    batch = batch.slice(same)
                    if batch.num_rows:
                        yield from solve(pa.Table.from_batches(held))
                        held, rows = [], 0
                    continue
                take = min(batch.num_rows, CHUNK - rows)
                held.append(batch.slice(0, take))
                rows += take
                last = groups[take - 1]
                batch = batch.slice(take)
        if held:
            yield from solve(pa.Table.from_batches(held))

    dealt = contexts.repartition("group").sortWithinPartitions("group")
    dealt = dealt.select("group", "key", "ctx", "lo", "before", "bytes", "parts")
    doc = doc.simpleString()
    lists = f"contexts array<long>, owners array<{doc}>, places array<int>"
    return dealt.mapInArrow(run, f"ctx long, strings array<int>, hash binary, lo {doc}, {lists}")


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, start and end (bytes) of what goes, and the ids of exact copies, which go whole."""
    spark = docs.sparkSession
    texts = narrow(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    copied = copies(texts)
    found = shared_anchors(texts, find_anchors, copied, _context_columns, "ctx long, start int, before int, size int")
    classes = found.groupBy("ctx").agg(
        F.min("doc_id").alias("lo"),
        F.min_by("start", "doc_id").alias("start"),
        *[F.min(c).alias(c) for c in ("key", "before", "size")],
        F.count("*").alias("times"),
    )
    classes = stored(classes, "classes")
    release(spark)
    # documents are compared by the first of each context only
    several = classes.groupBy("key").agg(F.count("*").alias("many"), F.min("lo").alias("a"), F.max("lo").alias("b"))
    open_ = classes.join(several.where("a < b").drop("a", "b"), "key").withColumn("parts", F.ceil(F.col("many") / GROUP).cast("int"))
    open_ = open_.withColumn("group", F.xxhash64("key", F.pmod("ctx", F.col("parts"))))
    open_ = stored(open_.drop("many", "times"), "open")
    # contexts that stand once take nothing from their document by themselves
    first = stored(classes.where("times > 1").select("ctx", "lo"), "first")
    discard(classes)
    release(spark)
    filled = stored(_with_bytes(texts, open_), "filled", compression="zstd")
    discard(open_)
    release(spark)
    told = stored(_compared(filled), "strings")
    discard(filled)
    release(spark)
    alone = told.where("hash IS NULL").select("ctx", "strings")
    combined = told.where("hash IS NOT NULL")
    least = combined.groupBy("hash").agg(F.min("lo").alias("least"))
    places = F.arrays_zip("contexts", "owners", "places")
    shared = combined.join(least, "hash").select("least", F.explode(places).alias("x")).where("least < x.owners")
    shared = shared.groupBy(F.col("x.contexts").alias("ctx")).agg(
        F.collect_list("x.places").alias("strings")  # at most one place for each byte before the anchor
    )
    strings = alone.union(shared)
    where = found.select("ctx", "doc_id", "start", "before", "size")
    # a document that is not the first of its context loses all of it; joined with one table, so
    # that Spark splits a very frequent context over several tasks
    joined = where.join(first.join(strings, "ctx", "full"), "ctx")
    whole = F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))
    spans = joined.where(whole | F.col("strings").isNotNull()).select(
        "doc_id",
        "ctx",
        "start",
        "before",
        "size",
        whole.alias("whole"),
        F.when(~whole, F.col("strings")).alias("strings"),
    )
    spans = stored(spans, "spans")
    discard(found, first, told)
    release(spark)
    return spans, copied


@scoped
def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes left, how many bytes there were and went, and in how many runs."""
    with freed(docs.sparkSession):
        spans, copied = removed_spans(docs)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("ctx", "start", "before", "size", "whole", "strings")).alias("spans"))
    rows = narrow(docs, "doc_id", "text").join(by_doc, "doc_id", "left")
    rows = rows.join(copied.withColumn("copy", F.lit(True)), "doc_id", "left")
    rows = rows.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, offsets, data in slices(batch.column(1)):
                gone = np.zeros(len(data) + 1, np.int32)
                copy = batch.column(3).slice(row, stop - row).to_pylist()
                lists = batch.column(2).slice(row, stop - row)
                count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                doc = np.repeat(np.arange(stop - row), count)
                flat = lists.flatten()
                part = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
                start = part("start") + offsets[doc]
                end = start + part("size")
                strings = flat.field("strings")
                many = np.nan_to_num(strings.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                each = np.repeat(np.arange(len(start)), many)
                # a span counts where the text has its context: rows of one id can differ
                ok = end <= offsets[doc + 1]
                held = _context_hashes(data, start[ok], end[ok], part("before")[ok].astype(np.int64))
                ok[ok] = held == part("ctx")[ok].view(np.uint64)
                whole = part("whole").astype(bool) & ok
                begin = start[each] + strings.flatten().to_numpy()
                begin = begin[ok[each]]
                begin, end = np.concatenate([start[whole], begin]), np.concatenate([end[whole], begin + MATCH])
                for i, c in enumerate(copy):
                    if c and offsets[i + 1] - offsets[i] >= MATCH:
                        begin, end = np.append(begin, offsets[i]), np.append(end, offsets[i + 1])
                np.add.at(gone, begin, 1)
                np.add.at(gone, end, -1)
                out = np.cumsum(gone[:-1]) > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                begins = out & (np.concatenate([[True], ~out[:-1]]) | edge[:-1])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
                left = data[~out]
                kept = np.concatenate([[0], np.cumsum(~out)])[offsets]
                raw = left.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row),
                        pa.array([raw[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
                        pa.array(np.diff(offsets)),
                        pa.array(total(out).astype(np.int64)),
                        pa.array(total(begins).astype(np.int64)),
                    ],
                    ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
                )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {doc}, kept binary, n_bytes long, n_removed long, n_spans long")


def digests(docs: DataFrame) -> DataFrame:
    """The counts and the digest of the bytes left of every document."""
    return deduplicated(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
