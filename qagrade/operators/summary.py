"""Mean scores per model and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.functions import vocab as V


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round the exact binary value, ties to even, as ``round(x, 2)`` does in Python.

    ``round`` and ``bround`` go by the printed decimal and differ from that: 0.615 is stored
    a little below the tie. Doubling the scale turns the tie into an odd whole number; the
    value is split into a 24-bit head and the rest, whose products with the scale are exact,
    so the sign of the distance to the tie is exact as well.
    """
    scale = 10**digits
    below = F.floor(value * scale)
    tie = (below * 2 + 1).cast("double")
    head = value.cast("float").cast("double")
    distance = (head * (2 * scale) - tie) + (value - head) * (2 * scale)
    up = (distance > 0) | ((distance == 0) & (below % 2 != 0))
    return (below + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale))


def _means(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row count and mean of every metric per group; a missing score counts 0."""
    means = [F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in V.METRICS]
    judged = F.count_if(F.col("judged") == len(V.VERDICTS)).alias("judged_n")
    labelled = F.avg(F.when(F.col("groundness").isNotNull(), F.col("groundness_correct")))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), judged, labelled.alias("groundness_correct_labelled"), *means
    )


def score_summary(df: DataFrame, by: str | None = None) -> DataFrame:
    """Mean of the 14 metrics over graded generations, rounded to 2 places.

    ``by`` gives one row per value of a column such as ``model``. The unrounded means are in
    ``<metric>_mean``. ``judged_n`` counts rows with all verdicts. As rows without a
    groundness label always grade 0 on it, ``groundness_correct_labelled`` gives the mean
    over the labelled rows. No rows give NULL and n = 0.
    """
    keys = [by] if by else []
    means = _means(df, keys)
    return means.select(
        *keys,
        "n",
        "judged_n",
        *[round_half_even(F.col(m)).alias(m) for m in V.METRICS],
        *[F.col(m).alias(f"{m}_mean") for m in V.METRICS],
        "groundness_correct_labelled",
    )


def score_long(df: DataFrame, by: str = "model") -> DataFrame:
    """The means in long form: (model, metric, mean, n); unpivoted after the aggregation."""
    return _means(df, [by]).unpivot([by, "n"], list(V.METRICS), "metric", "mean").select(by, "metric", "mean", "n")


def model_compare(df: DataFrame, base: str, other: str, by: str = "model") -> DataFrame:
    """Per metric the means of two models side by side and their difference."""
    long = score_long(df.filter(F.col(by).isin(base, other)), by)
    sides = long.groupBy("metric").agg(
        *[F.max(F.when(F.col(by) == model, F.col("mean"))).alias(side) for side, model in (("base", base), ("other", other))]
    )
    return sides.withColumn("difference", F.col("other") - F.col("base"))
