"""Queries with SQL twins agree with DuckDB."""

import duckdb
import pytest

from urlgauge.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))
