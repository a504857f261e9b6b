"""Every query with SQL gives the rows that DuckDB gives on the same files."""

import math
from decimal import Decimal

import duckdb
import pytest

from tessella import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return float(x) + 0.0 if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_flagship_runs(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() == 500
