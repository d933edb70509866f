import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """A documents table of the given texts, numbered from 0 unless pairs are given."""

    def make(texts, langs=None):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, (langs or ["en"] * len(rows))[k], "src", len(t or "")) for k, (i, t) in enumerate(rows)], DOCUMENTS)

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the smallest test table."""
    import duckdb

    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
