"""Every query gives the rows of its SQL."""

import os

import duckdb
import pytest

from folia.plans import catalog, oracle

SQL = oracle.statements()


def rows(columns, records):
    def value(v):
        if v is None or v != v:
            return "null"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(value(r[k]) for k in order) for r in records)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):
    made = catalog.queries()[name](spark, data)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows(made.columns, map(tuple, made.collect())) == rows(columns, want.fetchall())


def test_every_query_has_a_statement():
    assert set(SQL) == set(catalog.queries())


def test_flagship(spark, data):
    assert catalog.flagship(spark, data).count() == 6
