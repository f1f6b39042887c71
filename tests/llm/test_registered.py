"""The registered queries with SQL against DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from brindle.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    assert ordered(got.columns, got.collect()) == ordered(want.columns, want.fetchall())
