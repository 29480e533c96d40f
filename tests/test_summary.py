from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators import summary


def test_rounding_is_that_of_python(spark):
    rnd = random.Random(1)
    values = [k / 1000 for k in range(0, 1001)] + [k / 200 for k in range(0, 401)] + [k / 8 for k in range(80)]
    values += [rnd.random() for _ in range(2000)] + [0.285, 0.615, 1.005, 2.675, 99.995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", summary.round_half_even(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 2) for r in rows)


@pytest.fixture(scope="module")
def graded(spark):
    def row(model, n, judged, groundness, grade):
        scores = [n / 10] * len(V.METRICS)
        scores[V.METRICS.index("groundness_correct")] = grade
        scores[V.METRICS.index("faithfulness")] = None if judged < 3 else 1.0
        return (model, judged, groundness, *scores)

    schema = "model string, judged int, groundness string, " + ", ".join(f"{m} double" for m in V.METRICS)
    rows = [row("a", 1, 3, "g", 1.0), row("a", 2, 2, None, 0.0), row("a", 4, 2, None, 0.0), row("b", 5, 3, "g", 0.5)]
    return spark.createDataFrame(rows, schema)


def test_summary(graded):
    one = summary.score_summary(graded).first()
    assert (one.n, one.judged_n) == (4, 2)
    assert one.overall_score == 0.3 and one.overall_score_mean == pytest.approx(0.3)
    assert one.faithfulness == 0.5
    by_model = {r.model: r for r in summary.score_summary(graded, "model").collect()}
    assert by_model["a"].faithfulness == 0.33 and by_model["a"].judged_n == 1
    assert by_model["a"].groundness_correct == 0.33 and by_model["a"].groundness_correct_labelled == 1.0


def test_summary_of_nothing(graded):
    empty = summary.score_summary(graded.filter("model = 'none'")).first()
    assert empty.n == 0 and empty.overall_score is None and empty.overall_score_mean is None


def test_long_and_compare(graded):
    long = {(r.model, r.metric): (r["mean"], r.n) for r in summary.score_long(graded).collect()}
    assert len(long) == 2 * len(V.METRICS)
    assert long["b", "overall_score"] == (0.5, 1)
    sides = {r.metric: r for r in summary.model_compare(graded, "a", "b").collect()}
    assert set(sides) == set(V.METRICS)
    assert sides["faithfulness"].difference == pytest.approx(1 - 1 / 3)
