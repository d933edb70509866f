"""Loads into databases that can be run again: rows go to a staging table in parallel, and from there in one transaction."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_jdbc, write_jdbc


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def run(spark: SparkSession, url: str, *statements: str) -> list[int]:
    """Run statements in one transaction on the driver's connection; rows that each changed."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        done = [statement.executeUpdate(s) for s in statements]
        connection.commit()
        return done
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def append_absent(df: DataFrame, url: str, table: str, key: Sequence[str], load: str, types: str | None = None) -> int:
    """Append the rows whose key the table lacks; how many there were. A second run of a load, or one after a failure, appends what is missing and no more.

    df has one row for each key; rows with a null in the key go, since no run could know them again. The table is made
    where there is none. types: column types of new tables, such as ``link VARCHAR(200)``. The staging table of a load
    is replaced at its start and dropped with the transaction that copies it.
    """
    spark = df.sparkSession
    stage = f"{table}_{re.sub(r'[^A-Za-z0-9]', '_', load)}"
    options = {"createTableColumnTypes": types} if types else {}
    rows = df.dropna(subset=list(key))
    write_jdbc(rows.limit(0), url, table, **options)
    rows.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", stage).options(**options).save()
    columns = ", ".join(map(quoted, df.columns))
    same = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in key)
    copy = f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})"
    return run(spark, url, copy, f"DROP TABLE {stage}")[0]


def read_parts(spark: SparkSession, url: str, table: str, column: str, parts: int) -> DataFrame:
    """A table in parallel reads of about equal ranges of a numeric column, whose bounds the database tells; rows without a value come with the first."""
    least, most = read_jdbc(spark, url, table).agg(F.min(column), F.max(column)).first()
    if least is None or parts < 2:
        return read_jdbc(spark, url, table)
    return read_jdbc(spark, url, table, (column, int(least), int(most) + 1, parts))
