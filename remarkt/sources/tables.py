"""Tables in files and databases, and JSON configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Comma-separated text with a header, quoted line ends and, maybe, a byte order mark. Empty values are null, quoted or not."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """With a header in each file and, for spreadsheets, a byte order mark before it. Blanks at either end of a value stay."""
    first = df.columns[0]
    named = df.withColumnRenamed(first, "\ufeff" + first) if mark else df
    named.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table, or a query in brackets; partition: column, least and greatest value, and number of parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        reader = reader.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).save()


def read_config(*paths: str, default: dict | None = None) -> dict:
    """The first of the files that is there and is JSON, else the default."""
    for path in paths:
        try:
            return json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
    return {} if default is None else default


def lake_selection(raw: DataFrame) -> DataFrame:
    """Rows that the next load takes: extracted or not processed, and not junk (a missing mark is no junk)."""
    return raw.where(((F.col("status") == "extracted_layer2") | (F.col("processed") == F.lit(False))) & ~F.col("is_junk").eqNullSafe(F.lit(True)))


def label_candidates(raw: DataFrame, n: int = 3000) -> DataFrame:
    """The first n rows by link, with the columns that labelling needs."""
    return raw.select("name", "price", "explanation", "original_explanation", "source", "link").orderBy("link").limit(n)


def table_counts(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """table_name and n of the catalogue's tables and views."""
    names = names if names is not None else sorted(t.name for t in spark.catalog.listTables())
    out = spark.createDataFrame([], "table_name string, n bigint")
    for name in names:
        out = out.unionByName(spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n"))
    return out
