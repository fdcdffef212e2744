"""Every query with SQL, against that SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool, type(None))) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_equals_sql(spark, con, name):
    df = all_queries.QUERIES[name](spark, SF)
    rel = con.sql(all_queries.ORACLES[name])
    columns, want = rel.columns, rel.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, want)


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLES)))
def test_runs(spark, name):
    assert all_queries.QUERIES[name](spark, SF).count() > 0
