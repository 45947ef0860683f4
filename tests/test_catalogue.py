"""Every query of the library against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tidebook import catalogue, tables

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in tables.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    have, cols = [c[0] for c in cursor.description], sorted(df.columns)
    assert sorted(have) == cols
    want = sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).columns
