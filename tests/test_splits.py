from __future__ import annotations

import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qagrade.operators import splits
from qagrade.sources.scratch import pin, scope


def table(spark, sizes, partitions=4):
    """``sizes`` rows per stratum with keys 0, 1, 2, ..."""
    rows, key = [], 0
    for stratum, n in sizes.items():
        for _ in range(n):
            rows.append((key, stratum))
            key += 1
    return spark.createDataFrame(rows, "k long, s string").repartition(partitions)


def folder_of(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


def quotas(counts, total):
    rows = sum(counts.values())
    share = {s: total * n // rows for s, n in counts.items()}
    for s in sorted(counts, key=lambda s: (-(total * counts[s] % rows), s))[: total - sum(share.values())]:
        share[s] += 1
    return share


def brute_force(rows, sizes, seed):
    """Rank all rows of a stratum by hash and cut."""
    ordered = {}
    for k, s in rows:
        ordered.setdefault(s, []).append((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    ordered = {s: [k for _, k in sorted(v)] for s, v in ordered.items()}
    drawn = {}
    for name, size in sizes.items():
        for s, n in quotas({s: len(v) for s, v in ordered.items()}, size).items():
            drawn.update({k: name for k in ordered[s][:n]})
            ordered[s] = ordered[s][n:]
    return drawn


@pytest.mark.parametrize("roots", [0.01, 0.5, 8.0])
@pytest.mark.parametrize(
    "sizes", [{"train": 60, "heldout": 20}, {"train": 1, "heldout": 0}, {"a": 50, "b": 50, "c": 80}]
)
def test_draw_equals_brute_force(spark, monkeypatch, roots, sizes):
    """Also where the stretch looked at first is too narrow for the ends, and is widened."""
    monkeypatch.setattr(splits, "_ROOTS", roots)
    df = table(spark, {"hot": 120, "mid": 50, "cold": 10})
    drawn = splits.stratified_split(df, "k", "s", sizes, seed=5)
    got = {r.k: r.split for r in drawn.collect()}
    assert got == brute_force([(r.k, r.s) for r in df.collect()], sizes, 5)


def test_draw_is_the_same_on_other_partitions_and_differs_by_seed(spark):
    def draw(partitions, seed):
        df = table(spark, {"a": 90, "b": 60}, partitions)
        return {r.k: r.split for r in splits.stratified_split(df, "k", "s", {"x": 40, "y": 20}, seed).collect()}

    assert draw(1, 0) == draw(7, 0)
    assert draw(1, 0) != draw(1, 1)


def test_null_strata_are_not_drawn_and_columns_are_kept(spark):
    df = table(spark, {"a": 10, "b": 10}).unionByName(spark.createDataFrame([(99, None)], "k long, s string"))
    drawn = splits.stratified_split(df.withColumn("extra", F.lit(1)), "k", "s", {"x": 20})
    assert drawn.columns == ["k", "s", "extra", "split"]
    assert sorted(r.k for r in drawn.collect()) == list(range(20))


def test_too_small_tables_are_refused(spark):
    with pytest.raises(Exception, match="cannot draw 30 rows from 20"):
        splits.stratified_split(table(spark, {"a": 10, "b": 10}), "k", "s", {"x": 25, "y": 5}).collect()
    with pytest.raises(Exception, match="fewer than 2 rows"):
        splits.stratified_split(table(spark, {"a": 10, "b": 1}), "k", "s", {"x": 5}).collect()


def test_assembled_splits(spark):
    df = table(spark, {"[Relevant]": 300, "[Irrelevant]": 150}).withColumnRenamed("s", "relevance")
    whole = splits.assemble_splits(df, "k").cache()
    counts = Counter((r.split, r.relevance) for r in whole.collect())
    assert counts == {
        ("train", "[Relevant]"): 67, ("train", "[Irrelevant]"): 33,
        ("test", "[Relevant]"): 13, ("test", "[Irrelevant]"): 7,
        ("validation", "[Relevant]"): 14, ("validation", "[Irrelevant]"): 6,
    }
    assert whole.select("k").distinct().count() == 140
    assert whole.columns == ["k", "relevance", "split"]
    shares = {(r.split, r.relevance): r.share for r in splits.split_balance(whole).collect()}
    assert shares["train", "[Irrelevant]"] == pytest.approx(0.33)


def test_both_draws_equal_brute_force_in_few_jobs_and_leave_nothing(spark, tmp_path):
    df = table(spark, {"hot": 3000, "mid": 500, "cold": 40, "rare": 2}).withColumnRenamed("s", "relevance")
    df = pin(df, "table")
    before = set(os.listdir(folder_of(spark)))
    context = spark.sparkContext
    context.setJobGroup("draw", "draw")
    with scope():
        drawn = splits.assemble_splits(df, "k", train=1000, heldout=400)
        left = set(os.listdir(folder_of(spark))) - before
        rows = drawn.collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("draw"))
    context.setJobGroup("", "")
    assert len(left) == 1 and set(os.listdir(folder_of(spark))) == before
    assert jobs <= 17, jobs  # 15 without the two that read the result
    first = brute_force([(r.k, r.relevance) for r in df.collect()], {"train": 1000, "heldout": 400}, 0)
    held = [(r.k, r.relevance) for r in df.collect() if first.get(r.k) == "heldout"]
    want = {k: s for k, s in first.items() if s == "train"} | brute_force(held, {"test": 200, "validation": 200}, 1)
    assert {r.k: r.split for r in rows} == want


def test_rows_of_strata_without_held_out_rows_keep_their_split(spark):
    rows = [(k, "a" if k < 60 else "b", "train" if k >= 60 or k % 2 else "heldout") for k in range(80)]
    drawn = spark.createDataFrame(rows, "k long, s string, split string")
    halved = splits.split_holdout(drawn, "k", "s", {"x": 10, "y": 20})
    assert Counter(r.split for r in halved.collect()) == {"train": 50, "x": 10, "y": 20}


def test_many_strata_take_the_same_way(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.format_string("s%03d", F.col("id") % 300).alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = splits.stratified_split(df, "k", "s", {"x": 600, "y": 300})
        counts = Counter((r.split, r.s) for r in drawn.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(counts.values()) == {1, 2} and len(counts) == 600


@pytest.mark.parametrize(
    ("counts", "total"),
    [({"a": 5, "b": 3, "c": 2}, 7), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 3}, 3), ({"a": 10**12, "b": 10**11}, 10**10), ({"a": 4, "b": 0}, 2)],
)
def test_quota(spark, counts, total):
    df = spark.createDataFrame(list(counts.items()), "relevance string, n long")
    got = {r.relevance: r.quota for r in splits.stratum_quota(df, total).collect()}
    assert got == quotas(counts, total) and sum(got.values()) == total


def test_class_encode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("C",)], "s string")
    coded = splits.class_encode(df, "s", "code")
    assert sorted(map(tuple, coded.distinct().collect()), key=str) == [("C", 0), ("a", 1), ("b", 2), (None, None)]
    assert [(r.s, r.code) for r in splits.class_codes(df, "s", "code").orderBy("code").collect()] == [("C", 0), ("a", 1), ("b", 2)]


@pytest.mark.parametrize("n", [3, 1500])
def test_class_encode_is_one_way_for_any_number(spark, n):
    df = spark.range(n).select("id", F.format_string("s%05d", F.col("id")).alias("s"), F.lit(1).alias("z"))
    coded = splits.class_encode(df, "s", "code")
    assert coded.dtypes == [("id", "bigint"), ("s", "string"), ("z", "int"), ("code", "bigint")]
    assert all(r.id == r.code for r in coded.collect())


def test_split_overlap(spark):
    rows = [("a", "c", "train"), ("a", "c", "test"), ("b", "c", "train"), ("b", "c", "train"), (None, "c", "test")]
    df = spark.createDataFrame(rows, "instruction string, context string, split string")
    assert [(r.n, r.splits) for r in splits.split_overlap(df).collect()] == [(2, "test,train")]


def test_quality_filter(spark):
    ok = "é" * 301
    rows = [(1, ok, "r", ""), (2, "é" * 300, "r", "a"), (3, None, "r", "a"), (4, ok, None, "a"), (5, ok, "r", None)]
    df = spark.createDataFrame(rows, "k int, context string, relevance string, answer string")
    assert [r.k for r in splits.quality_filter(df).collect()] == [1]
    assert [r.k for r in splits.quality_filter(df, min_len=299).collect()] == [1, 2]
