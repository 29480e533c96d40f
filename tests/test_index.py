from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qagrade.operators.index import row_index


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 50, 10_000])
def test_contiguous_in_order(spark, rows_per_bucket):
    keys = random.Random(3).sample(range(-5000, 5000), 400)
    df = spark.createDataFrame([(k, "x") for k in keys], "k int, v string").repartition(5)
    rows = row_index(df, ["k"], rows_per_bucket=rows_per_bucket).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(400))
    assert [r["k"] for r in rows] == sorted(keys)
    assert set(rows[0].asDict()) == {"k", "v", "index"}


def test_several_columns_with_one_hot_leading_value(spark):
    # a single value leads most rows: bounds are over the whole key, so its rows are still spread
    df = spark.range(2000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k'\"\\ é"), F.col("id"))).alias("a"), "id"
    )
    indexed = row_index(df, ["a", "id"], rows_per_bucket=100)
    rows = indexed.orderBy("index").collect()
    assert [(r.a.encode(), r.id) for r in rows] == sorted((r.a.encode(), r.id) for r in rows)
    assert [r["index"] for r in rows] == list(range(2000))


def test_null_sorts_first_and_empty_table(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "k int")
    assert [(r["index"], r.k) for r in row_index(df, ["k"], rows_per_bucket=1).orderBy("index").collect()] == [(0, None), (1, 1), (2, 2)]
    assert row_index(df.filter("k > 5"), ["k"]).collect() == []


def test_same_index_whatever_the_partitioning(spark):
    df = spark.range(300).select((F.col("id") * 7919 % 1009).alias("k"))
    one, many = (dict(map(tuple, row_index(df.repartition(n), ["k"], rows_per_bucket=20).select("k", "index").collect())) for n in (1, 9))
    assert one == many
