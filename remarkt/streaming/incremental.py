"""The lake's new files through the batch plan, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def run_new_files(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, apply: Callable[[DataFrame, int], None], files: int | None = None) -> None:
    """Apply a batch function to all files that came since the last run, then stop; the checkpoint remembers which.

    A batch may be applied again after a failure, so apply should be idempotent, as the plans here are.
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    query = reader.parquet(path).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
