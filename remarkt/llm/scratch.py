"""Tables written between the jobs of one operator, in the folder all executors share, and broadcasts of bounded size."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..sources.store import delete, fresh, shared_dir

#: What scopes that are open have made, the innermost last.
_open: list[list] = []

#: Bytes of a batch that goes to a Python worker, where the session leaves Spark's default.
BATCH, BATCH_BYTES, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound what workers and the JVM beside them hold of long texts; a value that the session has set stays."""
    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path among this application's tables, deleted as they are."""
    path = fresh(spark, name)
    if _open:
        _open[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return it as read back: lineage ends here, and lost executors cost one read.

    The table stays until its scope ends, else until ``clear``: frames derived from it are lazy and may still need it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that goes when its scope ends."""
    held = spark.sparkContext.broadcast(value)
    if _open:
        _open[-1].append(held)
    return held


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables and broadcasts made inside go at its end: for results that are written inside it too."""
    made: list = []
    _open.append(made)
    try:
        yield
    finally:
        _open.pop()
        for x in made:
            delete(spark, x) if isinstance(x, str) else x.destroy()


def clear(spark: SparkSession) -> None:
    """Delete this application's tables, once the results made from them are written."""
    delete(spark, f"{shared_dir(spark)}/remarkt-{spark.sparkContext.applicationId}")
