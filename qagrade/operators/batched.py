"""Outside code, such as a model, applied to batches of rows inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from qagrade.sources.scratch import pin, scoped

Batch = pd.DataFrame
BATCH_ROWS = 64
BATCH_BYTES = 1 << 24


def row_bytes(frame: Batch) -> list[int]:
    """Bytes of each row: texts by their UTF-8 length, other values as eight."""

    def size(value: Any) -> int:
        if isinstance(value, str):
            return len(value.encode("utf-8", "surrogatepass"))
        return len(value) if isinstance(value, bytes | bytearray) else 8

    total = [0] * len(frame)
    for _, column in frame.items():
        plain = pd.api.types.is_numeric_dtype(column)
        total = [t + (8 if plain else size(v)) for t, v in zip(total, column)]
    return total


def batch_starts(sizes: list[int], batch_rows: int, batch_bytes: int) -> list[int]:
    """Rows at which batches begin: each has at most so many rows, and so many bytes unless it is one row."""
    starts, rows, held = [], 0, 0
    for i, size in enumerate(sizes):
        if not starts or rows == batch_rows or held + size > batch_bytes:
            starts.append(i)
            rows = held = 0
        rows, held = rows + 1, held + size
    return starts


def batched_apply(
    df: DataFrame,
    fn: Callable[..., Batch],
    schema: str,
    batch_rows: int = BATCH_ROWS,
    setup: Callable[[], Any] | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Run ``fn`` on batches of bounded rows and bytes, partition by partition.

    ``fn`` takes and returns a pandas frame; the keys it returns tie the results to their
    rows. ``setup`` is called once per partition, for instance to open a model, and its
    result is handed to ``fn`` as second argument. Nothing is collected: only one batch of a
    partition is in ``fn``'s hands at a time. A single row above ``batch_bytes`` is a batch of
    its own. The frames of which batches are cut follow Spark's own settings for Arrow batches.
    """

    def over_partition(frames: Iterator[Batch]) -> Iterator[Batch]:
        state = (setup(),) if setup else ()
        for frame in frames:
            starts = batch_starts(row_bytes(frame), batch_rows, batch_bytes)
            for start, end in zip(starts, [*starts[1:], len(frame)]):
                yield fn(frame.iloc[start:end].reset_index(drop=True), *state)

    return df.mapInPandas(over_partition, schema)


@scoped
def batched_store(
    df: DataFrame,
    fn: Callable[..., Batch],
    schema: str,
    name: str,
    batch_rows: int = BATCH_ROWS,
    setup: Callable[[], Any] | None = None,
    batch_bytes: int = BATCH_BYTES,
    batches_per_task: int = 16,
) -> DataFrame:
    """:func:`batched_apply` whose results are a stored table: what was asked once is not asked again.

    The rows are stored and dealt evenly to tasks of about ``batches_per_task`` batches. A task's
    results are committed to the shared folder when it ends, so a failing task or a lost executor
    asks again for the batches of unfinished tasks only.
    """
    rows = pin(df, f"{name}-asked")
    tasks = max(1, -(-rows.count() // (batch_rows * batches_per_task)))
    return pin(batched_apply(rows.repartition(tasks), fn, schema, batch_rows, setup, batch_bytes), name)
