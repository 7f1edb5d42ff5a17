"""Every query with SQL gives what DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert len(set(got.columns)) == len(got.columns)
    if name not in catalogue.ORACLE_SQL:
        return
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
    assert data or name in ("check_duplicate",)
    assert all(not (isinstance(x, float) and math.isnan(x)) for r in data for x in r)
