import duckdb
import pytest

from lodestrata.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = connection.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in result.fetchall())
