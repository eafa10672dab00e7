"""Every query of the registry against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quernstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    data = [tuple(r) for r in got.collect()]
    if name not in registry.ORACLES:
        assert data
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_flagship(spark, sf):
    assert registry.FLAGSHIP(spark, sf).count() > 0
