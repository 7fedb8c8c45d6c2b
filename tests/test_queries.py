"""Every query with its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")

ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def _rows(frame):
    cell = lambda x: "null" if x is None or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(int(x)) if type(x).__name__ in ("bool", "bool_") else str(x)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    got, expected = driver.queries()[name](spark, DATA).toPandas(), tables.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)


def test_flagship(spark):
    assert driver.entry(spark).count() > 0
