"""Toxicity by multiple-instance learning: sentences are scored, their noisy-or is the text's score.

Labels are of whole texts. A sentence's features are its words (A-Z lowered, signs at the ends
off) and their first 4, 6 and 7 characters, hashed. The sample of labelled rows is bounded
(`TRAINING_ROWS` and `TRAINING_BYTES`, those of least id hash of the labelled documents). Its features
are tested by the G statistic of their document counts, counted in Spark; of m tested ones those are
kept whose G is above log(m), which few do by luck, so their number follows the sample and no other
row has a say. A logistic weight for each and one bias
are fitted on the driver by the likelihood of the labels under
1 - product over sentences of (1 - sigmoid(weights)). Then every text is scored and its
sentences above `OFFENDING` are located.

Defined results: NULL and empty texts have no sentence and score 0; rows repeat as they are; only
`doc_id` and `text` of the documents are read; labels that are NULL do not train, an id labelled
twice counts as toxic if any of its labels is, equal texts of one id train once; without training rows of both labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qagrade.llm.common import Words, discard, lowered, narrow, slices, span_hashes, stored
from qagrade.sources.scratch import scope

TRAINING_ROWS = 20_000
TRAINING_BYTES = 96 << 20
MIN_ROWS = 3
PREFIXES = (4, 6, 7)
OFFENDING = 0.5
THRESHOLD = 0.7
_SIGN = np.isin(np.arange(256), list(b"\"'()*,-.:;<>?![]_`{}#"))
_STOP = np.isin(np.arange(256), list(b".!?"))
_FILTER_BITS = 20


def held_out(doc_id: Column, mod: int = 3, rest: int = 1) -> Column:
    """Whether the CRC-32 of the id as text has that remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


@dataclass
class Model:
    features: np.ndarray  #: sorted hashes
    weights: np.ndarray
    bias: float


class Sentences:
    """Sentences and word features of the texts of a slice."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.data = data = lowered(data)
        self.words = words = Words(offsets, data)
        n = len(words)
        lines = np.cumsum(data == 10)
        start, end = words.start.copy(), words.end.copy()
        last = np.ones(n, bool)  # whether a word is the last of its sentence
        if n > 1:
            last[:-1] = (
                _STOP[data[words.end[:-1] - 1]]
                | (lines[words.start[1:]] != lines[words.end[:-1] - 1])
                | (words.doc[1:] != words.doc[:-1])
            )
        #: Sentence of each word; sentences are numbered over the slice.
        self.of_word = np.concatenate([[0], np.cumsum(last)[:-1]]) if n else np.zeros(0, np.int64)
        self.count = int(last.sum()) if n else 0
        ends = np.flatnonzero(last)
        begins = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        self.start, self.end = words.start[begins], words.end[ends]
        self.doc = words.doc[ends]
        for _ in range(3):
            end = np.where((end - start > 1) & _SIGN[data[end - 1]], end - 1, end) if n else end
            start = np.where((end - start > 1) & _SIGN[data[start]], start + 1, start) if n else start
        self.left, self.right = start, end

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, hashes of one kind of feature)."""
        everything = np.arange(len(self.words))
        yield everything, span_hashes(self.data, self.left, self.right)
        first = np.flatnonzero((self.data & 0xC0) != 0x80)  # first bytes of characters
        begin, end = np.searchsorted(first, self.left), np.searchsorted(first, self.right)
        for k in PREFIXES:
            longer = np.flatnonzero(end - begin > k)
            # the constant tells a prefix from a word of the same letters
            yield longer, span_hashes(self.data, self.left[longer], first[begin[longer] + k]) ^ np.uint64(k)


def _found(sentences: Sentences, known: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, number of the feature) of every occurrence of a known feature."""
    where, which = [], []
    for word, hashes in sentences.features():
        maybe = np.flatnonzero(screen[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        at = np.searchsorted(known, hashes[maybe])
        hit = known[np.minimum(at, len(known) - 1)] == hashes[maybe]
        where.append(sentences.of_word[word[maybe[hit]]])
        which.append(at[hit])
    return np.concatenate(where), np.concatenate(which)


def _screen(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[known & np.uint64((1 << _FILTER_BITS) - 1)] = True
    return out


# --- training ------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, size: int = TRAINING_BYTES) -> DataFrame:
    """The texts and labels (`toxic` 0 or 1) of the bounded sample."""
    own = narrow(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = narrow(docs, "doc_id", "text").withColumn("which", F.xxhash64("text"))
    # the bound is of documents that are there, one row an id and text
    own = texts.select("doc_id", "which", F.octet_length("text").alias("size")).join(own, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("which")]
    # `rows` rows at most, so the window and the broadcast are bounded
    held = F.sum("size").over(Window.orderBy(*order))
    own = own.orderBy(*order).limit(rows).withColumn("held", F.coalesce(held, F.lit(0))).where(F.col("held") <= size)
    own = own.select("doc_id", "which", "toxic")
    found = texts.join(F.broadcast(own), ["doc_id", "which"])
    return found.groupBy("doc_id", "which").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def telling_features(train: DataFrame) -> np.ndarray:
    """Hashes of the features that speak for or against the label by their document counts, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for row, _, offsets, data in slices(batch.column(0)):
                own = Sentences(offsets, data)
                if not own.count:
                    continue
                doc = np.concatenate([own.words.doc[w] for w, _ in own.features()])
                value = np.concatenate([h for _, h in own.features()])
                by = np.lexsort((doc, value))
                doc, value = doc[by], value[by]
                new = np.ones(len(by), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                value, bad = value[new], toxic[row + doc[new]]
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                n, n_bad = np.diff(np.append(first, len(value))), np.add.reduceat(bad, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[first].view(np.int64)), pa.array(n_bad), pa.array(n - n_bad)],
                    ["feature", "bad", "good"],
                )

    counts = train.select("text", F.col("toxic").cast("long")).mapInArrow(run, "feature long, bad long, good long")
    counts = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    bad, good = train.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    bad, good = bad or 0, good or 0
    if not bad or not good:
        return np.zeros(0, np.uint64)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n = F.col("bad") + F.col("good")
    gain = F.lit(0.0)
    for seen, total in (("bad", bad), ("good", good)):
        share = total / (bad + good)
        gain = gain + term(F.col(seen), n * share) + term(total - F.col(seen), (bad + good - n) * share)
    # the gain is half of G
    tested = stored(counts.where(n >= MIN_ROWS).select("feature", gain.alias("gain")), "features")
    kept = tested.where(2 * F.col("gain") >= float(np.log(max(tested.count(), 1)))).select("feature").toArrow()
    discard(tested)
    return np.sort(kept["feature"].to_numpy().astype(np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Weights of the telling features from the bounded sample of labelled rows."""
    with scope():
        return _fitted(stored(training_rows(docs, labels, rows), "toxicity-sample"))


def _fitted(train: DataFrame) -> Model:
    known = telling_features(train)
    if not len(known):
        return Model(np.zeros(1, np.uint64), np.zeros(1), -np.inf)
    screen = _screen(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for row, end, offsets, data in slices(batch.column(0)):
                own = Sentences(offsets, data)
                sentence, which = _found(own, known, screen)
                counts = np.bincount(own.doc, minlength=end - row)
                doc = own.doc[sentence]
                own_first = np.searchsorted(own.doc, np.arange(end - row))
                for i in range(end - row):
                    mine = doc == i
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([toxic[row + i]], pa.int32()),
                            pa.array([int(counts[i])], pa.int64()),
                            pa.array([(sentence[mine] - own_first[i]).tolist()], pa.list_(pa.int32())),
                            pa.array([which[mine].tolist()], pa.list_(pa.int32())),
                        ],
                        ["toxic", "sentences", "sentence", "which"],
                    )

    bags = train.select("text", F.col("toxic").cast("int")).mapInArrow(
        run, "toxic int, sentences long, sentence array<int>, which array<int>"
    )
    bags = bags.orderBy(F.hash("toxic", "sentences", "which")).toArrow()  # of the bounded sample
    lists = [bags["sentence"].combine_chunks(), bags["which"].combine_chunks()]
    weights, bias = noisy_or_fit(
        bags["toxic"].to_numpy() > 0,
        bags["sentences"].to_numpy(),
        *[np.split(x.flatten().to_numpy(), x.offsets.to_numpy()[1:-1]) for x in lists],
        len(known),
    )
    return Model(known, weights, bias)


class Bags:
    """Texts as bags of sentences, and the penalised loss of weights and bias on their labels."""

    PENALTY = 0.05

    def __init__(self, toxic: np.ndarray, sentences: np.ndarray, sentence: list, which: list, features: int):
        owner, unit, feature, at = [], [], [], 0
        for i, (s, w) in enumerate(zip(sentence, which, strict=True)):
            distinct, own = np.unique(s, return_inverse=True)
            owner.append(np.full(len(distinct), i))
            unit.append(own + at)
            feature.append(w)
            at += len(distinct)
        self.owner, self.unit, self.feature = (np.concatenate(x).astype(np.int64) for x in (owner, unit, feature))
        self.toxic, self.units, self.features = toxic, at, features
        #: sentences without a feature
        self.plain = sentences - np.bincount(self.owner, minlength=len(toxic))

    def _odds(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each sentence with a feature, and each text's log chance of no offending sentence."""
        z = value[-1] + np.bincount(self.unit, value[:-1][self.feature], minlength=self.units)
        none = -np.bincount(self.owner, np.logaddexp(0, z), minlength=len(self.toxic)) - self.plain * np.logaddexp(0, value[-1])
        return z, none

    def loss(self, value: np.ndarray) -> float:
        _, none = self._odds(value)
        with np.errstate(divide="ignore"):
            likely = np.where(self.toxic, np.log(-np.expm1(none)), none)
        return float(-likely.sum() + self.PENALTY / 2 * (value[:-1] ** 2).sum())

    def slope(self, value: np.ndarray) -> np.ndarray:
        z, none = self._odds(value)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-value[-1]))
        # derivative of the loss by the log chance of no offending sentence
        pull = np.where(self.toxic, np.exp(none) / np.maximum(-np.expm1(none), 1e-9), -1.0)
        by_unit = -pull[self.owner] * p
        slope = np.empty(self.features + 1)
        slope[:-1] = np.bincount(self.feature, by_unit[self.unit], minlength=self.features) + self.PENALTY * value[:-1]
        slope[-1] = by_unit.sum() - (pull * self.plain).sum() * p0
        return slope


def noisy_or_fit(
    toxic: np.ndarray, sentences: np.ndarray, sentence: list, which: list, features: int, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest penalised likelihood, by Adam over whole bags."""
    bags = Bags(toxic, sentences, sentence, which, features)
    value, mean, square = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    value[-1] = -5.0
    for step in range(1, steps + 1):
        slope = bags.slope(value)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        value = value - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return value[:-1], float(value[-1])


# --- scoring -------------------------------------------------------------------------------

SPANS = "array<struct<start: long, end: long, score: double>>"


def _scores(own: Sentences, model: Model, screen: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each sentence, and the noisy-or of each text."""
    sentence, which = _found(own, model.features, screen)
    z = np.bincount(sentence, model.weights[which], minlength=own.count)[: own.count] + model.bias
    none = np.bincount(own.doc, np.logaddexp(0, z), minlength=texts)[:texts]
    return z, -np.expm1(-none)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the offending sentences (code points, end exclusive) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        screen = _screen(model.features)
        for batch in batches:
            for row, end, offsets, data in slices(batch.column(1)):
                own = Sentences(offsets, data)
                z, scores = _scores(own, model, screen, end - row)
                found = np.flatnonzero(z > np.log(OFFENDING / (1 - OFFENDING)))
                spans: list[list] = [[] for _ in range(end - row)]
                if len(found):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for s in found.tolist():
                        base = points[offsets[own.doc[s]]]
                        spans[own.doc[s]].append(
                            {
                                "start": int(points[own.start[s]] - base),
                                "end": int(points[own.end[s]] - base),
                                "score": float(1 / (1 + np.exp(-z[s]))),
                            }
                        )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(scores), pa.array(spans, pa.list_(span))],
                    ["doc_id", "score", "offending"],
                )

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {doc_kind}, score double, offending {SPANS}")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all columns, whose texts score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        screen = _screen(model.features)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, end, offsets, data in slices(batch.column(at)):
                own = Sentences(offsets, data)
                keep[row:end] = _scores(own, model, screen, end - row)[1] < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on labelled rows outside the held-out third, then score all documents."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "offending",
    )
