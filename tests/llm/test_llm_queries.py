import os

import duckdb
import pytest

from folia.llm import bpe_sql, queries

SQL = queries.oracle_sql() | {"p6_ids": bpe_sql.ids()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    made = queries.queries()[name](spark, data)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(made.columns) == sorted(columns)
    assert sorted(map(tuple, made.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_query_has_its_statement():
    assert set(SQL) == set(queries.queries())
