"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import os

import pytest

from symweave import catalog

TABLES = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def value(v):
    return None if v is None else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(TABLES):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, TABLES)
    got = sorted(str([value(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(str([value(r[k]) for k in order]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, TABLES).count() >= 0
