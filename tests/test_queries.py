"""Every query with SQL against DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from remarkt.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.columns) == sorted(rel.columns)
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert sum(got.values()) == sum(want.values())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
