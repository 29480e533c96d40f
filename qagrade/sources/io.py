"""Tables, named splits, JSON lines and score files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from qagrade.functions import vocab as V


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """A stored table, or one of its named splits."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if split is None else read_split(df, split)


def read_split(df: DataFrame, name: str) -> DataFrame:
    """The rows of one split; on a table written by :func:`write_splits` others are not read."""
    return df.filter(F.col("split") == name)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split.

    Rebalancing joins the few rows that a small draw leaves in each of many partitions and
    cuts a large split into files of even size.
    """
    df.hint("rebalance", F.col("split")).write.mode(mode).partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, order_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls written out.

    ``order_by`` writes the lines in order over all files; a reader that needs the order
    takes it from the column.
    """
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by an explicit schema; columns without a value are NULL, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def score_schema(keys: Sequence[str] = ("model",)) -> StructType:
    """Schema of a score file: keys, row count and the 14 metrics under their written names."""
    return StructType(
        [StructField(k, StringType()) for k in keys]
        + [StructField("n", LongType())]
        + [StructField(V.METRIC_LABELS.get(m, m), DoubleType()) for m in V.METRICS]
    )


def write_scores(df: DataFrame, path: str, keys: Sequence[str] = ("model",), mode: str = "errorifexists") -> None:
    """A score summary as one JSON object per model, with the hyphenated metric names."""
    named = [F.col(m).alias(V.METRIC_LABELS.get(m, m)) for m in V.METRICS]
    write_jsonl(df.select(*keys, "n", *named), path, mode=mode)
