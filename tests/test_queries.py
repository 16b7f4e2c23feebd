"""Every registered query of the engine against its DuckDB form on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from reelframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted(tuple(repr(plain(r[c])) for c in columns) for r in frame.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    assert mine == sorted(tuple(repr(plain(r[k])) for k in order) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
