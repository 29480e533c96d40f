"""Anchors: a sparse choice of places, equal in equal stretches, that tells where texts repeat.

Of each window of `window` symbols the k-gram of least hash is an anchor. The choice depends on
the window's content alone, so a window that occurs in two texts has the same anchor in both: a
window whose anchor occurs in one document only need not be looked at. Anchors are counted with
partial sums before the shuffle. A filter of those that repeat, of a bounded size, goes to the texts
then, and spares the shuffle of most others as long as it is large enough for them. What passes is
joined with the stored list of those that repeat: both sides are plain shuffles, so Spark splits a
very frequent anchor over several tasks.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qagrade.llm.common import discard, key_filter, slices, stored


def running(extreme: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Extreme of every `width` neighbours."""
    n, out, span = len(values) - width + 1, values, 1
    while span * 2 <= width:
        out = extreme(out[:-span], out[span:])
        span *= 2
    return extreme(out[:n], out[width - span : width - span + n]) if span < width else out


def anchor_places(hashes: np.ndarray, width: int, inside: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some `width` neighbours (all of several equal ones).

    `inside` tells which windows lie within one text; others choose nothing, so that a text's
    anchors do not depend on the texts around it.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    least = np.zeros(n + width - 1, hashes.dtype)
    least[width - 1 : n] = np.where(inside, running(np.minimum, hashes, width), 0)
    return np.flatnonzero(hashes == running(np.maximum, least, width))


#: Of a slice's offsets and bytes: text number, place and key of every anchor.
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Of a slice's offsets and bytes, and its anchors' text numbers and places: the columns kept of them.
Columns = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes the shuffle files of a step when the step ends, not only after its
    garbage has been collected. For steps that store their results, as nothing else reads those files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _anchors(texts: DataFrame, find: Finder, known: Broadcast | None = None, columns: Columns | None = None, more: str = "") -> DataFrame:
    """key and doc_id of all anchors, or with a filter those that pass it and their columns, `more`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, offsets, data in slices(batch.column(1)):
                doc, at, key = find(offsets, data)
                if known:
                    kept = known.value.passes(key)
                    doc, at, key = doc[kept], at[kept], key[kept]
                held = [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row + doc))]
                if known:
                    held += [pa.array(c) for c in columns(offsets, data, doc, at)]
                for a in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 100_000) for c in held], names)

    doc = texts.schema["doc_id"].dataType.simpleString()
    names = ["key", "doc_id"] + [c.split()[0] for c in more.split(", ") if c]
    return texts.mapInArrow(run, ", ".join([f"key long, doc_id {doc}"] + [more] * bool(more)))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of the documents whose whole text also has a smaller id, stored: narrow throughout."""
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"), F.length("text").alias("n")
    )
    hashed = stored(hashed, "hashes")  # three steps need them: the texts are read once
    firsts = hashed.groupBy("one", "two", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where(F.col("first") < F.col("last")).drop("last")
    found = hashed.join(firsts, ["one", "two", "n"]).where(F.col("doc_id") > F.col("first"))
    # an id that is both a copy and something else keeps its place among the texts
    several = hashed.groupBy("doc_id").agg(F.min("one").alias("a"), F.max("one").alias("b")).where("a <> b")
    out = stored(found.select("doc_id").distinct().join(several, "doc_id", "left_anti"), "copies")
    discard(hashed)
    return out


def _repeated(anchors: DataFrame) -> DataFrame:
    """The anchors that several documents have, stored."""
    spans = anchors.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return stored(spans.where(F.col("lo") < F.col("hi")).select("key"), "anchors")


#: So many ids of copies go to the tasks whole. Else Spark deals all anchors by their documents for
#: them, a second shuffle as large as the one before it.
COPIES = 2_000_000


def shared_anchors(texts: DataFrame, find: Finder, copied: DataFrame, columns: Columns, more: str) -> DataFrame:
    """key, doc_id and columns of the anchors of several documents, less those in exact copies, stored.
    Some then have one document left."""
    spark = texts.sparkSession
    several = _repeated(_anchors(texts, find))
    known = spark.sparkContext.broadcast(key_filter(several))
    release(spark)
    left = F.broadcast(copied) if copied.count() <= COPIES else copied
    found = _anchors(texts, find, known, columns, more).join(several, "key").join(left, "doc_id", "left_anti")
    found = stored(found.select("key", "doc_id", *[c.split()[0] for c in more.split(", ")]), "places")
    known.destroy()
    discard(several)
    release(spark)
    return found


def repeated_places(texts: DataFrame, find: Finder, copied: DataFrame) -> DataFrame:
    """key, doc_id and place of the anchors of several documents, exact copies left out, stored."""
    spark = texts.sparkSession
    found = shared_anchors(texts, find, copied, lambda offsets, data, doc, at: [at.astype(np.int32)], "at int")
    left = _repeated(found)
    out = stored(found.join(left, "key"), "places")
    discard(found, left)
    release(spark)
    return out
