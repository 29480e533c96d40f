"""A contiguous row index over a table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.sources.scratch import pin, scoped

#: ``monotonically_increasing_id`` has the partition above this bit and the row in it below.
_ROW_BITS = 33


def placed(df: DataFrame, order_by: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order_by``, sorted, and stored once with each row's place.

    Places ascend with the order but leave gaps between partitions. Spark's own sort spills, so
    a partition may have any size; their number is that of all shuffles unless it is given.
    ``df`` is read twice, for the bounds of the ranges and for its rows.
    """
    ranges = df.repartitionByRange(*([partitions] if partitions else []), *order_by)
    sorted_ = ranges.sortWithinPartitions(*order_by)
    return pin(sorted_.withColumn(out, F.monotonically_increasing_id()), "placed")


def _partition(place: Column) -> Column:
    return F.shiftright(place, _ROW_BITS).cast("int")


@scoped
def row_index(df: DataFrame, order_by: Sequence[str], out: str = "index", rows_per_bucket: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``order_by``, which has to be unique.

    Rows are written once, sorted, with their place in their partition, and numbered as they are
    read again: the sizes of the earlier partitions, one number each, are added. No window runs
    over the rows and they are moved once. ``rows_per_bucket`` sets the partitions' size, at the
    price of a count; without it their number is that of all shuffles. All columns of ``df`` are
    moved, so a wide table should be numbered by its keys and joined with them.
    """
    partitions = max(1, -(-df.count() // rows_per_bucket)) if rows_per_bucket else None
    rows = placed(df, list(order_by), "_place", partitions)
    sizes = rows.groupBy(_partition(F.col("_place")).alias("part")).agg(F.count("*").alias("n")).collect()
    before, total = [0] * (1 + max((r.part for r in sizes), default=0)), 0
    for r in sorted(sizes):
        before[r.part], total = total, total + r.n
    place = F.col("_place")
    number = F.get(F.lit(before).cast("array<bigint>"), _partition(place)) + place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.select(*df.columns, number.alias(out))
