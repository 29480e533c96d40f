"""Every registered query against its DuckDB statement on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from qagrade.plans.queries import QUERIES
from qagrade.sources.scratch import scope

SQL = driver.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(SQL) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    with scope():
        compare(driver.queries()[name](spark, sf_dir), con, name)
    assert set(os.listdir(folder)) == before


def compare(df, con, name):
    columns = sorted(df.columns)
    expected = con.sql(SQL[name])
    assert sorted(expected.columns) == columns
    types = dict(df.dtypes)
    assert {c: TYPES[types[c]] for c in columns} == dict(zip(expected.columns, map(str, expected.types)))
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    wanted = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert ordered(map(tuple, rows)) == ordered(wanted)
    assert rows


def test_entry(spark):
    assert driver.entry(spark).count() > 0
