"""N-gram Jaccard join: grouped prefix join of the documents' shingle sets.

Shingles are ordered from rare to frequent by a fixed-size count sketch (any order is right, this
one makes the prefixes telling). Two sets of m and n shingles that are similar enough have o in
common, by their sizes, so they share `SHARED` of the first m - o + `SHARED` shingles of one and
n - o + `SHARED` of the other, or all o if that is less. Documents of equal sets are one set; sets
of equal prefixes and size are one group. Group pairs come from shared shingles at such places, are
filtered by size and by how many they share, and are expanded to their sets, which are made from
the texts and verified exactly.

Only connected components are asked for, so what is connected need not be paired again: first
each prefix shingle pairs its groups with `HUBS` of them only, which joins large families of near
copies with a few pairs a member. After that all pairs are taken between what is still
apart, so no link between components is lost. There, what a shingle has in common is paired by
component and size first, and only such pairs are expanded to their groups, so a large family costs
nothing once it is one component. To be verified, pairs are dealt to one of their sets, which is
kept in the task while the sets of its partners pass by; a set with very many partners is kept in
several tasks. Of the texts, only those of sets in pairs are shuffled: filters of bounded size tell
which are wanted, and what passes is joined exactly.

Words are runs of anything but the space and the characters 9 to 13, A-Z lowered. Defined
results: NULL texts and texts without words have no shingles and are their own component; rows
with a NULL id link with nothing and have a NULL component; rows of equal ids are rows of their
own. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.llm.anchors import release
from qagrade.llm.common import Words, discard, key_filter, lowered, narrow, sequence_hash, shingle_sets, slices, stored
from qagrade.llm.components import components
from qagrade.sources.scratch import scoped

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 22
SEGMENT_BITS = 16
HUBS = 3
PARTNERS = 128  #: sets that are compared with one kept set in a task, about
SHARED = 2  #: prefix shingles that similar sets have in common at least


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of documents by the low bits of their hash, as classes of about a quarter octave.

    Tasks send their counts as segments of bytes (255: so many or more), so what is sent does not
    depend on the texts' length; segments are added in Spark and come to the driver as one byte
    a bucket.
    """
    size, segment = 1 << SKETCH_BITS, 1 << SEGMENT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in batches:
            for _, _, offsets, data in slices(batch.column(0)):
                _, hashes = Words(offsets, lowered(data)).windows(k)
                np.add.at(total, (hashes & np.uint64(size - 1)).astype(np.int64), 1)
        small = np.minimum(total, 255).astype(np.uint8)
        for i in range(size // segment):
            part = small[i * segment : (i + 1) * segment]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = totals.setdefault(i, np.zeros(segment, np.int64))
                total += np.frombuffer(counts, np.uint8)
        for i, total in totals.items():
            level = np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()])], ["segment", "counts"])

    schema = "segment int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("segment").mapInArrow(add, schema)
    out = np.zeros(size, np.uint8)
    for i, levels in zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True):
        out[i * segment : (i + 1) * segment] = np.frombuffer(levels, np.uint8)
    return out


#: Arrays fill a writer's memory up to this; tasks share theirs with Python.
_ROW_GROUPS = {"parquet.block.size": str(16 << 20)}


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, set, grp and prefix (rare shingles first) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        low = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for row, stop, offsets, data in slices(batch.column(1)):
                size, sets, groups, prefixes = [], [], [], []
                for _, own in shingle_sets(Words(offsets, lowered(data)), k):
                    n = len(own)
                    order = np.argsort(levels[own & low], kind="stable")  # equal levels by hash
                    prefix = own[order[: n - (percent * n + 99) // 100 + SHARED]] if n else own
                    size.append(n)
                    sets.append(sequence_hash(own))
                    groups.append(sequence_hash(np.append(prefix, np.uint64(n))))
                    prefixes.append(prefix.view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row),
                        batch.column(2).slice(row, stop - row),
                        pa.array(size, pa.int64()),
                        pa.array(np.array(sets, np.uint64).view(np.int64)),
                        pa.array(np.array(groups, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    ["doc_id", "text_hash", "n", "set", "grp", "prefix"],
                )

    doc = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", _text_hash().alias("text_hash"))
    out = rows.mapInArrow(run, f"doc_id {doc}, text_hash long, n long, set long, grp long, prefix array<long>")
    return stored(out, "prefixes", **_ROW_GROUPS)


def _set_texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """set and text of the wanted documents (doc_id), stored. A filter of their ids goes to all texts, which
    are not shuffled; what passes besides them has sets that no pair names."""
    known = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64("doc_id").alias("key"))))
    rows = docs.where("doc_id IS NOT NULL").select("text", F.xxhash64("doc_id").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = known.value.passes(batch.column(1).to_numpy().view(np.uint64))
            texts = batch.column(0).filter(pa.array(passed))
            for row, _, offsets, data in slices(texts):
                own = [(row + i, sequence_hash(s)) for i, s in shingle_sets(Words(offsets, lowered(data)), k) if len(s)]
                sets = np.array([x for _, x in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sets), texts.take(pa.array([i for i, _ in own], pa.int64()))], ["set", "text"])

    out = stored(rows.mapInArrow(run, "set long, text string"), "sets", compression="zstd", **_ROW_GROUPS)
    known.destroy()
    return out


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _common(percent: int) -> Column:
    """Shingles that similar sets of sizes xn and yn have in common at least."""
    return F.ceil(percent * (F.col("xn") + F.col("yn")) / (100 + percent))


def _places_fit(percent: int) -> Column:
    """Whether the places xat and yat are among those at which similar sets share `SHARED` shingles."""
    first = _common(percent) - SHARED
    return (F.col("xat") < F.col("xn") - first) & (F.col("yat") < F.col("yn") - first)


def _shared_enough(count: str, percent: int) -> Column:
    return F.col(count) >= F.least(F.lit(SHARED), _common(percent))


def _compared(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. b is kept in a task, the sets a pass by in its order. They come
    as texts, which take about half the room of their shingles in a shuffle, and are made again there."""
    lead = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("tasks"))
    tasks = F.explode(F.sequence(F.lit(1).cast("long"), F.col("tasks")))
    kept = sets.join(lead, sets["set"] == lead["b"]).select("b", tasks.alias("part"), F.lit(None).cast("long").alias("a"), "text")
    dealt = pairs.join(lead, "b").select("a", "b", (F.pmod(F.xxhash64("a"), F.col("tasks")) + 1).alias("part"))
    passing = dealt.join(sets, dealt["a"] == sets["set"]).select("b", "part", "a", "text")
    rows = kept.unionByName(passing).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            one, other = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, _, offsets, data in slices(batch.column(3)):
                for i, shingles in shingle_sets(Words(offsets, lowered(data)), k):
                    a = other[row + i]
                    if a is None:
                        own = shingles
                    elif len(own) and len(shingles):
                        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
                        common = int((own[at] == shingles).sum())
                        if 100 * common >= percent * (len(own) + len(shingles) - common):
                            found.append((a, one[row + i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches the bound, stored."""
    pairs = stored(pairs, "pairs")
    release(docs.sparkSession)
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    sets = _set_texts(docs, members.join(wanted, "set").select("doc_id"), k)
    release(docs.sparkSession)
    rows = _compared(pairs, sets, k, percent)
    out = stored(rows, "links")
    discard(sets, pairs)
    release(docs.sparkSession)
    return out


@scoped
def similar(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return _components_of(docs, k, percent).drop("text_hash")


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    docs = narrow(docs, "doc_id", "text")
    base = _prefixes(docs, k, percent)
    release(spark)
    real = base.where("n > 0 AND doc_id IS NOT NULL")
    members = real.groupBy("grp", "set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = stored(members, "members")
    groups = members.groupBy("grp").agg(F.min(F.struct("doc_id", "set")).alias("lead"))
    leads = stored(groups.select("grp", "lead.doc_id", "lead.set"), "leads")
    postings = _postings(real, leads)
    # sets of one group meet in its lead, groups of a shingle in its hubs
    inner = members.join(leads.select("grp", F.col("set").alias("b")), "grp").where(F.col("set") != F.col("b"))
    stars = _stars(postings, percent).join(leads.select(F.col("grp").alias("x"), F.col("set").alias("a")), "x")
    stars = stars.join(leads.select(F.col("grp").alias("y"), F.col("set").alias("b")), "y").select("a", "b")
    links = _verified(inner.select(F.col("set").alias("a"), "b").union(stars).distinct(), docs, members, k, percent)
    labels = components(links)
    rest = _all_pairs(postings, members, labels, percent)
    links = stored(links.union(_verified(rest, docs, members, k, percent)), "links")
    labels = components(links)
    named = real.join(labels, real["set"] == labels["node"], "left").select(
        "set", "doc_id", F.coalesce("label", "set").alias("label")
    )
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = named.select("set", "label").distinct().join(least, "label").select("set", "component_id")
    out = base.join(of_set, "set", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _tokens(rows: DataFrame, lead: Broadcast, wanted: Broadcast | None = None) -> DataFrame:
    """token of the prefixes (grp, n, prefix, key) whose key passes a filter, or with a filter of tokens
    grp, n, at and token of those that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            led = batch.filter(pa.array(lead.value.passes(batch.column(3).to_numpy().view(np.uint64))))
            ends, flat = led.column(2).offsets.to_numpy(), led.column(2).values.to_numpy()
            token = flat[ends[0] : ends[-1]]
            columns, names = [pa.array(token)], ["token"]
            if wanted:
                kept = np.flatnonzero(wanted.value.passes(token.view(np.uint64)))
                row = np.searchsorted(ends[1:] - ends[0], kept, "right")
                at = pa.array((kept - (ends[row] - ends[0])).astype(np.int32))
                columns = [led.column(0).take(pa.array(row)), led.column(1).take(pa.array(row)), at, pa.array(token[kept])]
                names = ["grp", "n", "at", "token"]
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in columns], names)

    return rows.mapInArrow(run, "grp long, n long, at int, token long" if wanted else "token long")


def _postings(real: DataFrame, leads: DataFrame) -> DataFrame:
    """grp, n, at and token of the groups' prefix shingles that several groups have, stored.

    Each group's prefix comes from the row that leads it. Filters of a bounded size tell those rows, and
    the shingles that occur twice: prefixes are not shuffled, and of their shingles only the bare hashes, to
    be counted, and what passes. A row that passes wrongly gives postings that its group has already, which
    are dropped with those of equal rows; a shingle that does is dropped by the exact join.
    """
    spark = real.sparkSession
    lead = spark.sparkContext.broadcast(key_filter(leads.select(F.xxhash64("grp", "doc_id", "set").alias("key"))))
    rows = real.select("grp", "n", "prefix", F.xxhash64("grp", "doc_id", "set").alias("key"))
    several = stored(_tokens(rows, lead).groupBy("token").count().where("count > 1").select("token"), "tokens")
    release(spark)
    wanted = spark.sparkContext.broadcast(key_filter(several.select(F.col("token").alias("key"))))
    out = stored(_tokens(rows, lead, wanted).join(several, "token").select("grp", "n", "at", "token").distinct(), "postings")
    lead.destroy()
    wanted.destroy()
    discard(several)
    release(spark)
    return out


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """Each group of a shingle with a few of them: HUBS times as many pairs as postings at most."""
    # the group with the fewest rarer shingles, which is what near copies have most in common, and others
    orders = [[F.col("at")], *[[] for _ in range(HUBS - 1)]]
    hub = lambda i: F.min(F.struct(*orders[i], F.xxhash64("grp", F.lit(i)).alias("o"), "grp"))
    hubs = postings.groupBy("token").agg(F.array_distinct(F.array(*[hub(i)["grp"] for i in range(HUBS)])).alias("hubs"))
    hubs = hubs.select("token", F.explode("hubs").alias("hub"))
    ends = postings.select("token", F.col("grp").alias("hub"), F.col("n").alias("yn"), F.col("at").alias("yat"))
    rows = postings.select("token", "grp", F.col("n").alias("xn"), F.col("at").alias("xat"))
    rows = rows.join(hubs.join(ends, ["token", "hub"]), "token").where(F.col("grp") != F.col("hub"))
    rows = rows.where(_sizes_fit(F.col("xn"), F.col("yn"), percent) & _places_fit(percent))
    # near copies have the same hub for most shingles; what this leaves out is paired later
    pairs = rows.groupBy(F.col("grp").alias("x"), F.col("hub").alias("y"), "xn", "yn").count()
    return pairs.where(_shared_enough("count", percent)).select("x", "y")


def _all_pairs(postings: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components whose groups share enough prefix shingles, or are one.

    What meets in a shingle are its components by size, one row each, and of those that fit their
    groups: groups of one component never meet.
    """
    named = members.join(labels, members["set"] == labels["node"], "left").select("grp", "set", F.coalesce("label", "set").alias("label"))
    named = stored(named, "named")
    rows = postings.join(named.select("grp", "label").distinct(), "grp")
    several = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rows = stored(rows.join(several, "token"), "open")
    side = lambda x: [F.col(c).alias(f"{x}{c}") for c in ("grp", "n", "at", "label")]
    met = rows.groupBy("token", "label", "n").agg(F.min("at").alias("at"))
    met = met.select("token", *[F.col(c).alias(f"x{c}") for c in ("label", "n", "at")]).join(
        met.select("token", *[F.col(c).alias(f"y{c}") for c in ("label", "n", "at")]), "token"
    )
    fit = _sizes_fit(F.col("xn"), F.col("yn"), percent) & _places_fit(percent)
    met = met.where((F.col("xlabel") < F.col("ylabel")) & fit).drop("xat", "yat")
    both = met.join(rows.select("token", *side("x")), ["token", "xlabel", "xn"]).join(rows.select("token", *side("y")), ["token", "ylabel", "yn"])
    # groups of different components have all shingles that they share among these
    pairs = both.where(_places_fit(percent)).groupBy("xgrp", "ygrp", "xlabel", "ylabel", "xn", "yn").count()
    pairs = pairs.where(_shared_enough("count", percent))
    end = lambda x, name: named.select(F.col("grp").alias(f"{x}grp"), F.col("label").alias(f"{x}label"), F.col("set").alias(name))
    across = pairs.join(end("x", "a"), ["xgrp", "xlabel"]).join(end("y", "b"), ["ygrp", "ylabel"]).select("a", "b")
    # sets of one group, of equal prefix and size, that are still apart
    mixed = named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("grp")
    inner = named.join(mixed, "grp")
    within = inner.select("grp", F.col("set").alias("a"), F.col("label").alias("la")).join(
        inner.select("grp", F.col("set").alias("b"), F.col("label").alias("lb")), "grp"
    )
    return across.union(within.where("la < lb").select("a", "b")).distinct()


@scoped
def without_similar(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all columns, of one document of each component: that of least id.

    Rows are judged by their id and text: of an id with several texts, one can stay and another
    go. Rows that are equal in both are one document, and stay or go together. Rows with a NULL id stay.
    """
    found = _components_of(docs, k, percent).where("component_id <> doc_id")
    found = stored(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "similar")
    return _without(docs, found)


def _passing(docs: DataFrame, known: Broadcast, wanted: bool) -> DataFrame:
    """The rows of `docs`, with all columns, whose id and text pass a filter, or those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = known.value.passes(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(passed == wanted))

    return docs.select("*", F.xxhash64("doc_id", _text_hash()).alias("_key")).mapInArrow(run, docs.schema)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` but those of a found id and text (_id, _hash). A filter tells most rows that stay,
    which are not shuffled; the others are joined."""
    known = docs.sparkSession.sparkContext.broadcast(key_filter(found.select(F.xxhash64("_id", "_hash").alias("key"))))
    gone = (F.col("doc_id") == F.col("_id")) & (_text_hash() == F.col("_hash"))
    rest = _passing(docs, known, True).join(found, gone, "left_anti").select(docs.columns)
    return _passing(docs, known, False).union(rest)
