"""Queries of the operators that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from proofmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
