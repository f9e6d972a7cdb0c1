"""Every query against its DuckDB SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pavescope.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def key(row):
    return tuple(("", "") if v is None else (type(v).__name__, v) if not isinstance(v, (int, float)) else ("n", round(float(v), 3)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    assert got.columns
    if name not in ORACLES:
        assert got.count() >= 0
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(got.columns)
    cols = sorted(got.columns)
    a, b = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key), sorted((tuple(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float, type(None))) and v is not None and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6)) or str(u) == str(v), (name, x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
