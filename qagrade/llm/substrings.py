"""Substring deduplication over words: a de Bruijn graph of repeated word runs, compacted.

Edges are runs of `WINDOW` words, nodes the runs one shorter that two neighbouring edges share.
Anchors tell which places can repeat at all; only their edges are made. Each edge is combined
into its least document, its source coordinates (document and word), its frequency and the edge before
it, if that is always the same. It goes on with a path if that edge is as frequent, which a join
of the edges with themselves tells; otherwise it begins one. All edges of a nonbranching
path occur together, so a path is compacted along its source coordinates to its first edge and
its length, and a join of first edges with occurrences gives the long repeated spans. Spans are
verified where the texts are: the words there have to give the path's first and last edge.

A word is removed if an edge over it also starts in a document with a smaller id. Defined
results: NULL and empty texts have no words; texts of fewer than `WINDOW` words keep all; rows
with a NULL id keep all and count for no other; rows of equal ids do not remove from each other;
an exact copy of a smaller id's text loses all words if it has `WINDOW` or more. Only `doc_id`
and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qagrade.llm.anchors import anchor_places, copies, release, repeated_places, running
from qagrade.llm.common import Words, discard, narrow, slices, stored
from qagrade.sources.scratch import scoped

WINDOW = 13
SEED = 5


def find_anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and hash of the word runs of SEED words that anchor their windows."""
    words = Words(offsets, data)
    at, key = words.windows(SEED)
    doc, width = words.doc[at], WINDOW - SEED + 1
    chosen = anchor_places(key, width, doc[: len(at) - width + 1] == doc[width - 1 :])
    doc = doc[chosen]
    return doc, at[chosen] - words.first[doc], key[chosen]


def _edges(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Every edge that can repeat: edge, the one before it (0: none), document, word."""
    wanted = places.groupBy("doc_id").agg(F.collect_list("at").alias("at"))  # places of one text
    rows = narrow(docs, "doc_id", "text").join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for row, stop, offsets, data in slices(batch.column(1)):
                words = Words(offsets, data)
                at, key = words.windows(WINDOW)
                if not len(at):
                    continue
                own = lists.slice(row, stop - row)
                text = np.repeat(np.arange(stop - row), own.value_lengths().to_numpy())
                known = np.zeros(len(words) + 1, bool)
                known[np.minimum(own.flatten().to_numpy() + words.first[text], len(words))] = True
                # an edge can repeat if its own least word run is one of the places
                seeds, value = words.windows(SEED)
                kept = np.where(known[seeds], value, np.uint64(0xFFFFFFFFFFFFFFFF))
                first = np.searchsorted(seeds, at)
                least = running(np.minimum, value, WINDOW - SEED + 1)[first]
                chosen = np.flatnonzero(least == running(np.minimum, kept, WINDOW - SEED + 1)[first])
                at, key = at[chosen], key[chosen]
                doc = words.doc[at]
                before = np.zeros(len(at), np.uint64)
                follows = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
                before[1:] = np.where(follows, key[:-1], 0)
                columns = [
                    pa.array(key.view(np.int64)),
                    pa.array(before.view(np.int64)),
                    batch.column(0).take(pa.array(row + doc)),
                    pa.array((at - words.first[doc]).astype(np.int32)),
                ]
                for a in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [c.slice(a, 100_000) for c in columns], ["edge", "before", "doc_id", "at"]
                    )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"edge long, before long, doc_id {doc}, at int")


def compacted_paths(edges: DataFrame) -> DataFrame:
    """first and last edge, length in edges and source (document, word) of the nonbranching paths of
    edges that several documents have."""
    table = edges.groupBy("edge").agg(
        F.min("doc_id").alias("source_doc"),
        F.min_by("at", "doc_id").alias("source_at"),
        F.max("doc_id").alias("hi"),
        F.min("before").alias("before"),
        F.max("before").alias("other"),
        F.count("*").alias("times"),
    )
    table = stored(table.where("source_doc < hi").drop("hi"), "edges")
    release(edges.sparkSession)
    # an edge with one edge before it goes on with that one's path if they are equally frequent:
    # then the one before has no other edge after it
    previous = table.select(F.col("edge").alias("before"), F.col("times").alias("times_before"))
    joined = table.join(previous, "before", "left")
    on = (F.col("before") == F.col("other")) & (F.col("before") != 0) & (F.col("times") == F.col("times_before"))
    first = ~F.coalesce(on, F.lit(False))
    along = Window.partitionBy("source_doc").orderBy("source_at", "edge")
    flagged = joined.select("edge", "before", "source_doc", "source_at", first.alias("first"))
    # the source place of each edge of a path follows that of the one before; a gap begins anew, and
    # so does an edge that comes after one of another text of that id
    gap = F.col("source_at") - F.coalesce(F.lag("source_at").over(along), F.lit(-2)) != 1
    other = F.coalesce(F.lag("edge").over(along) != F.col("before"), F.lit(True))
    flagged = flagged.withColumn("begins", (F.col("first") | gap | other).cast("int"))
    numbered = flagged.withColumn("path", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    paths = numbered.groupBy("source_doc", "path").agg(
        F.min_by("edge", "source_at").alias("edge"),
        F.max_by("edge", "source_at").alias("last"),
        F.count("*").cast("int").alias("length"),
        F.min("source_at").alias("source_at"),
    )
    return paths.select("edge", "last", "length", "source_doc", "source_at")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Long repeated spans: document, first word, path's edges, and the source they repeat, for the
    documents whose id is not the source's."""
    texts = narrow(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    places = repeated_places(texts, find_anchors, copied := copies(texts))
    edges = stored(_edges(texts, places), "occurrences")
    discard(places, copied)
    release(docs.sparkSession)
    paths = compacted_paths(edges)
    spans = edges.select("edge", "doc_id", "at").join(paths, "edge").where(F.col("doc_id") > F.col("source_doc"))
    spans = stored(spans.select("doc_id", "at", "length", "edge", "last", "source_doc", "source_at"), "spans")
    discard(edges)
    release(docs.sparkSession)
    return spans


def _removed(words: Words, key: np.ndarray, at: np.ndarray, i: int, copy: bool, spans: list) -> np.ndarray:
    """Which words of text `i` go."""
    a, b = words.first[i], words.first[i + 1]
    gone = np.zeros(b - a, bool)
    if copy and b - a >= WINDOW:
        gone[:] = True
    for span in spans or ():
        start, end = a + span["at"], a + span["at"] + span["length"] - 1
        where = np.searchsorted(at, [start, end])
        ok = end + WINDOW <= b and key[where[0]] == np.int64(span["edge"]).view(np.uint64)
        if ok and key[where[1]] == np.int64(span["last"]).view(np.uint64):
            gone[start - a : end - a + WINDOW] = True
    return gone


@scoped
def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, the text of the words left, and how many there were and went."""
    texts = narrow(docs, "doc_id", "text")
    spans = repeated_spans(docs)
    copied = copies(texts)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "length", "edge", "last")).alias("spans"))
    rows = texts.join(by_doc, "doc_id", "left").join(copied.withColumn("copy", F.lit(True)), "doc_id", "left")
    rows = rows.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, offsets, data in slices(batch.column(1)):
                words = Words(offsets, data)
                at, key = words.windows(WINDOW)
                spans, copy = batch.column(2).slice(row, stop - row), batch.column(3).slice(row, stop - row)
                kept, gone = [], []
                raw = data.tobytes()
                for i in range(stop - row):
                    out = _removed(words, key, at, i, copy[i].as_py(), spans[i].as_py())
                    left = np.flatnonzero(~out) + words.first[i]
                    pairs = zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)
                    kept.append(b" ".join([raw[a:b] for a, b in pairs]))
                    gone.append(int(out.sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array(np.diff(words.first)),
                        pa.array(gone, pa.int64()),
                    ],
                    ["doc_id", "text", "n_words", "n_removed"],
                )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {doc}, text string, n_words long, n_removed long")


def digests(docs: DataFrame) -> DataFrame:
    """The counts and the digest of the words left of every document."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


