"""Every registered query of the library against its DuckDB oracle, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES = {k: f for part in entry.CATALOG for k, f in part.QUERIES.items()}
ORACLES = {k: x for part in entry.CATALOG for k, x in part.ORACLES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
