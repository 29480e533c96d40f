"""Intermediate tables in the folder that all machines of the cluster share, and who deletes them.

Every pinned table has an owner: the innermost :func:`scope` at the time it is written. A scope
deletes what it owns when it ends, all but the tables that a result handed over still reads, which
then belong to the scope around it. What is left outside any scope goes when the process ends.

    with scratch.scope():
        io.write_table(splits.assemble_splits(rows, "row_id"), out)   # nothing stays behind
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_named: str | None = None
_Fn = TypeVar("_Fn", bound=Callable[..., DataFrame])


class Scope:
    """Owns the tables that were written while it was the innermost scope."""

    def __init__(self) -> None:
        self._owned: dict[str, SparkSession] = {}

    def own(self, spark: SparkSession, path: str) -> None:
        self._owned[path] = spark

    def hand_over(self, outer: Scope, *results: DataFrame) -> None:
        """Leave the tables that the results read to ``outer``; table names are unique."""
        names = {part for df in results for file in df.inputFiles() for part in file.split("/")}
        for path in [p for p in self._owned if p.rsplit("/", 1)[1] in names]:
            outer.own(self._owned.pop(path), path)

    def drop(self, path: str) -> None:
        spark = self._owned.pop(path, None)
        if spark is not None:
            delete(spark, path)

    def close(self) -> None:
        for path in list(self._owned):
            self.drop(path)

    def __len__(self) -> int:
        return len(self._owned)


_ROOT = Scope()
_current: ContextVar[Scope] = ContextVar("qagrade_scope", default=_ROOT)


@atexit.register
def _at_exit() -> None:
    for path in list(_ROOT._owned):
        with contextlib.suppress(Exception):  # the session may be gone
            _ROOT.drop(path)


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Delete, at the end, what is pinned inside. Use the results inside too."""
    own = Scope()
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)
        own.close()


def scoped(fn: _Fn) -> _Fn:
    """An operator that deletes its own tables, all but those that its result reads."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        outer = _current.get()
        with scope() as own:
            result = fn(*args, **kwargs)
            own.hand_over(outer, result)
        return result

    return run


def use_folder(path: str | None) -> None:
    """Name the shared folder for sessions that have no ``spark.checkpoint.dir``."""
    global _named
    _named = path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below a folder that the caller has named.

    No folder is guessed: without either it is an error. The current scope owns the path.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or _named
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared.rstrip('/')}/qagrade-{name}-{uuid.uuid4().hex}"
    _current.get().own(spark, path)
    return path


def pin(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write an intermediate table and read it back.

    What is read later no longer depends on how it was computed, so neither a lost executor
    nor a second use computes it again. Its size is known to the optimiser, which decides
    on that size whether to broadcast it. The scope deletes it, or :func:`unpin` before that.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    pinned = df.sparkSession.read.schema(df.schema).parquet(path)
    pinned._pinned_at = path
    return pinned


def unpin(*tables: DataFrame) -> None:
    """Delete pinned tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_pinned_at", None)
        if path:
            _current.get().drop(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
