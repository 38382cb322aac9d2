"""Every query of the core against its SQL twin on the smallest tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from stewardry.queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:26] if hasattr(v, "isoformat") else v


def rows_of(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.sql(ORACLES[name])
    names = list(want.columns)
    columns = sorted(got.columns)
    assert columns == sorted(names)
    assert rows_of(columns, got.columns, got.collect()) == rows_of(columns, names, want.fetchall())
