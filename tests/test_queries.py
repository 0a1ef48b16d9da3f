"""Every query against its SQL on the smallest tables, and the others for their rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from tideline.plans import estimators, extras, oracle, queries

assert extras  # registers its queries and SQL

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    text = str(v)
    return text.removesuffix(" 00:00:00")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(name, spark, sf, duck):
    df = (queries.QUERIES | estimators.QUERIES)[name](spark, sf)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    cur = duck.execute(oracle.SQL[name])
    want_columns = [c[0] for c in cur.description]
    want = rows(want_columns, cur.fetchall())
    assert sorted(df.columns) == sorted(want_columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-4), (a, b)
            else:
                assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(set(estimators.QUERIES) - set(oracle.SQL)))
def test_estimators_give_rows(name, spark, sf):
    assert estimators.QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(oracle.SQL) <= set(e.queries())
