"""Registered queries against their SQL twins, over whole tables."""

import duckdb
import pytest

from marketloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    wanted = connection.execute(queries.ORACLES[name])
    names = [c[0] for c in wanted.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, wanted.fetchall()))
