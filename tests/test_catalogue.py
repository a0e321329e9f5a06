"""Every query with a SQL twin gives the twin's rows at the smallest scale."""

import glob
import math
import os
from datetime import datetime
from decimal import Decimal

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(records):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, float | Decimal):
            return f"{float(x):.6f}"
        return x.isoformat() if isinstance(x, datetime) else str(x)

    return sorted(tuple(cell(r[k]) for k in sorted(r)) for r in records)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    said = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(r.asDict() for r in df.collect()) == rows(dict(zip(said.columns, r)) for r in said.fetchall())


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
