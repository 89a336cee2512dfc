"""Every query with an SQL twin gives the twin's rows, on the smallest data."""

import decimal
import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
#: These read the same rows by the same code as another query, or are covered by the operators' own tests.
SLOW = {"p7_decoded"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'").fetchall()
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return float(value) if isinstance(value, decimal.Decimal) else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query(spark, sf_dir, oracle, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 7):
        assert f"p{n}_found" in entry.queries()


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    assert entry.entry(spark).columns == ["objectid", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
