"""Every registered query against its SQL, on the smallest tables."""

import importlib

import duckdb
import pytest

from rankflow.registry import QUERIES, SQL

for module in ("feature", "gate", "model", "rating", "source", "strategy", "stream"):
    importlib.import_module(f"rankflow.plans.{module}_queries")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v if isinstance(v, bool | int | str) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(a, b):
    return a == b or (a is not None and b is not None and isinstance(a, float | int) and abs(a - b) <= 2e-5 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
