"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

The ratio compares two multinomials over hashed n-grams: one of trusted texts (labelled good; at
most `TARGET_ROWS` of them, those of least id hash) and one of the whole raw corpus. A text's
verdict is the mean log ratio of its n-grams against a fixed threshold, so it does not depend on
other rows' order and every text is decided. N-grams are of runs of letters and digits and runs
of signs, which tells ornaments and tables from prose.

Defined results: NULL and empty texts have no words, fail the base rule and score 0; rows repeat
as they are; only `doc_id` and `text` are read, so other columns may have any name; without
trusted texts both multinomials are flat against each other and only the raw one speaks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.llm.common import narrow
from qagrade.sources.scratch import scoped

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
THRESHOLD = -0.25
MIN_WORDS = 50
REPEAT_PERCENT = 50
_SYMBOL = "[#*$%&|<>]+"
_SPACE = r"[\x20\x09-\x0D]+"
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of anything but the space and the characters 9 to 13."""
    return F.array_remove(F.split(text, _SPACE), "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _head(array: Column, less: int) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - less, F.lit(0)))


def _tail(array: Column, skip: int) -> Column:
    return F.slice(array, skip + 1, F.greatest(F.size(array) - skip, F.lit(0)))


def _grams(tokens: Column, buckets: int):
    """For a token and its place: the buckets of the 1-gram and of the 2-gram that begin there. The
    last token makes a 2-gram with the end. `buckets` is a power of two."""
    low = F.lit(buckets - 1).cast("long")
    return lambda x, i: (
        F.xxhash64(x).bitwiseAND(low).cast("int"),
        F.xxhash64(x, F.coalesce(F.get(tokens, i + 1), F.lit(""))).bitwiseAND(low).cast("int"),
    )


def trusted_ids(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Distinct ids of at most `rows` trusted texts, those of least hash of the ids that have a text."""
    good = narrow(labels, "doc_id", "quality").where("quality = 1 AND doc_id IS NOT NULL")
    good = good.select("doc_id").distinct().join(narrow(docs, "doc_id"), "doc_id", "left_semi")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> list[float]:
    """Log ratio of each bucket. All texts are counted; one row a bucket comes to the driver."""
    trusted = F.broadcast(trusted_ids(docs, labels, rows).withColumn("trusted", F.lit(1)))  # `rows` ids at most
    grams = narrow(docs, "doc_id", "text").join(trusted, "doc_id", "left").select("trusted", tokens(F.col("text")).alias("t"))
    both = _grams(F.col("t"), buckets)
    pairs = F.transform("t", lambda x, i: F.array(*both(x, i)))
    grams = grams.select("trusted", F.explode(F.flatten(pairs)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good")).collect()
    raw, good = [1] * buckets, [1] * buckets
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        good[row["bucket"]] += row["good"]
    all_raw, all_good = math.log(sum(raw)), math.log(sum(good))
    return [math.log(g) - all_good - math.log(r) + all_raw for g, r in zip(good, raw, strict=True)]


def ratio_score(tokens: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a text's n-grams; 0 without any."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    both = _grams(tokens, len(ratios))

    def ratio(x: Column, i: Column) -> Column:
        one, two = both(x, i)
        return table[one] + table[two]

    total = F.aggregate(F.transform(tokens, ratio), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(tokens) > 0, total / (2 * F.size(tokens))).otherwise(0.0)


def window_hashes(words: Column) -> Column:
    """Hash of every 3-word window."""
    return F.transform(_head(words, 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def sorted_windows(hashes: Column) -> Column:
    """(hash, first word) of all windows, in that order; NULL if no two are equal."""
    window = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, window)))


def repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more in the text, from its sorted windows."""
    same = F.zip_with(
        _head(windows, 1), _tail(windows, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    firsts = F.array_distinct(F.flatten(F.array_compact(same)))
    covered = F.flatten(F.transform(firsts, lambda i: F.array(i, i + 1, i + 2)))
    return F.when(windows.isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


@scoped
def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The counts of every document, the base rule, the mean log ratio and the verdict."""
    ratios = log_ratios(docs, labels)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    # Arrays get columns of their own before they are read twice, so each is made once a text.
    rows = rows.select(
        "doc_id",
        words(F.col("text")).alias("words"),
        tokens(F.col("text")).alias("tokens"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("text") - _without(F.col("text"), _SYMBOL)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("hashes"),
        ratio_score(F.col("tokens"), ratios).alias("log_ratio"),
    )
    rows = rows.withColumn("windows", sorted_windows(F.col("hashes"))).drop("hashes")
    rows = rows.withColumn("n_repeat_words", repeat_words(F.col("windows"))).drop("windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)
    )
