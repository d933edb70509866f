import duckdb
import pytest

from remarkt.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
