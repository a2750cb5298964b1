"""Corpus queries against their SQL on DuckDB."""

import duckdb
import pytest

from siftwork.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    out = queries.QUERIES[name](spark, sf)
    assert sorted(out.columns) == columns
    rows = want.df()[columns].astype(object).values.tolist()
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
