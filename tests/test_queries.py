"""The registered queries against their SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from brindle import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in queries.TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def table(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


def test_every_query_gives_rows_or_a_plan(spark):
    for name in ("describe", "explain"):
        assert queries.queries()[name](spark, SF).count() > 0
