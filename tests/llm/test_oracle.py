"""The registered queries that have a DuckDB statement, on the smallest tables."""
import duckdb
import pytest

from vellum.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    res = con.execute(oracle.SQL[name])
    cols = [d[0] for d in res.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, res.fetchall()))
