"""Registered queries against their SQL, on the small test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def rows(df):
    columns = sorted(df.columns)
    clean = [tuple(None if v is None or v != v else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)]
    return columns, sorted(clean, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(db.sql(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
