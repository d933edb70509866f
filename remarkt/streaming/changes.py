"""The log of price changes of a stream: each key's last price is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPrice(StatefulProcessor):
    """Gives the rows of a key whose price isn't the one before, in their order; null is a price, and the first row of a key is no change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "nth"], kind="stable")
        known = self.last.exists()
        last, out = (self.last.get()[0] if known else None), []
        for row in batch.itertuples(index=False):
            price = None if pd.isna(row.price) else float(row.price)
            if known and price != last:
                out.append((key[0], row.at, row.nth, last, price))
            known, last = True, price
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "nth", "old_price", "price"]).astype({"old_price": "float64", "price": "float64"})

    def close(self) -> None:
        pass


def change_log(stream: DataFrame) -> DataFrame:
    """key, at, nth, old_price and price of the rows of a stream (key, at, nth, price) at which a key's price changes.

    Rows of a batch are taken in the order of at and nth, batches as they come: a stream that is cut in that order gives
    the log that its whole would, after a restart too. A task holds one key's rows of a batch, which the source's limit
    of files for each trigger bounds. Rows without a key go. Needs the RocksDB state store (``with_state``).
    """
    kind = stream.schema["key"].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("at", T.TimestampType()), T.StructField("nth", T.LongType()), T.StructField("old_price", T.DoubleType()), T.StructField("price", T.DoubleType())])
    rows = stream.where(F.col("key").isNotNull()).select("key", F.col("at").cast("timestamp"), F.col("nth").cast("bigint"), F.col("price").cast("double"))
    return rows.groupBy("key").transformWithStateInPandas(LastPrice(), outputStructType=out, outputMode="Append", timeMode="None")


def run_change_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the log of all that came since the last run to Parquet at path, then stop."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        change_log(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def batch_log(df: DataFrame) -> DataFrame:
    """The same log of a table at rest."""
    from pyspark.sql import Window

    own = Window.partitionBy("key").orderBy("at", "nth")
    price = F.col("price").cast("double")
    rows = df.where(F.col("key").isNotNull()).withColumns({"old_price": F.lag(price).over(own), "_i": F.row_number().over(own)})
    return rows.where((F.col("_i") > 1) & ~price.eqNullSafe(F.col("old_price"))).select("key", F.col("at").cast("timestamp"), F.col("nth").cast("bigint"), "old_price", price.alias("price"))
