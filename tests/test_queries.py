"""Every catalog query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from stratavox.plans import volume_queries  # noqa: F401  (adds its queries)
from stratavox.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        assert found[1]
        return
    result = oracle.sql(ORACLE_SQL[name])
    wanted = rows(result.columns, result.fetchall())
    assert found == wanted


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
