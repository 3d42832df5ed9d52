"""Every registered query against its SQL at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from gazeframe.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, duck, name):
    frame = driver.queries()[name](spark, SF)
    got = bag(frame.columns, frame.collect())
    text = driver.oracle_sql().get(name)
    if text is None:
        assert got
        return
    cursor = duck.execute(text)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == bag(columns, cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
