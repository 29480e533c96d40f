"""Operators leave nothing in the shared folder once their result is used, and need a folder."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

import corpus_pipeline
from qagrade.llm import queries
from qagrade.llm.common import stored
from qagrade.sources import scratch


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_nothing_is_left(spark, sf_dir, name):
    query = queries.QUERIES.get(name, corpus_pipeline.run)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    with scratch.scope():
        assert query(spark, sf_dir).count() >= 0
    assert set(os.listdir(folder)) == before


def test_no_folder_is_made_up(spark):
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    named, scratch._named = scratch._named, None
    try:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stored(SimpleNamespace(sparkSession=bare), "x")
    finally:
        scratch._named = named
