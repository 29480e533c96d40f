"""What registered queries need besides the library: a folder for sessions that name none, as in tests."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

from qagrade.sources.scratch import use_folder


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="qagrade-queries-")


def ensure_folder(spark: SparkSession) -> None:
    """The library names no folder of its own; this harness does where the session has none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        use_folder(_own_folder())
