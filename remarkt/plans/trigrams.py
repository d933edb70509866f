"""Keyword search by an index of trigrams: their postings give candidates, ILIKE confirms these alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def grams(text: Column) -> Column:
    """Unlike runs of three characters in lower case; none in shorter texts."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))).otherwise(F.array().cast("array<string>"))


def literal_runs(keyword: str) -> list[str]:
    """What a keyword says in letters between its wildcards; a backslash takes the next character as it is."""
    runs, held, escaped = [], "", False
    for c in keyword:
        if escaped or c not in "%_\\":
            held, escaped = held + c, False
        elif c == "\\":
            escaped = True
        else:
            runs, held = [*runs, held], ""
    return [r for r in [*runs, held] if r]


class TrigramIndex:
    """An index over items (id, name, other columns) under path: postings parted by their gram, items by their id.

    A gram's postings lie in one part and may be many; they stay rows. Rows without a name are in no search.
    """

    def __init__(self, spark: SparkSession, path: str, id: str = "id", text: str = "name", parts: int = PARTS):
        self.spark, self.path, self.id, self.text, self.parts = spark, path.rstrip("/"), id, text, parts

    def _part(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def build(self, items: DataFrame) -> TrigramIndex:
        placed = items.where(F.col(self.text).isNotNull()).withColumn("_block", self._part(F.col(self.id).cast("string")))
        placed.repartition(F.col("_block")).write.partitionBy("_block").parquet(f"{self.path}/items")
        posted = placed.select(F.col(self.id).alias("_id"), F.col("_block").alias("_in"), F.explode(grams(F.col(self.text))).alias("_gram")).withColumn("_part", self._part(F.col("_gram")))
        # rows of frequent grams are dealt by item too
        posted.repartition(F.col("_part"), F.pmod(F.xxhash64("_id"), F.lit(8))).sortWithinPartitions("_part", "_gram").write.partitionBy("_part").parquet(f"{self.path}/postings")
        return self

    def search(self, keyword: str) -> DataFrame:
        """Items whose name holds the keyword (% and _ are wildcards), in any case. Without three letters in a row all items are read."""
        items = self.spark.read.parquet(f"{self.path}/items")
        runs = [self.spark.sql("SELECT lower(:run)", args={"run": r}).first()[0] for r in literal_runs(keyword)]
        wanted = sorted({x[i : i + 3] for x in runs for i in range(len(x) - 2)})
        says = F.expr("ilike(`{}`, concat('%', {}, '%'))".format(self.text, "'" + keyword.replace("\\", "\\\\").replace("'", "\\'") + "'"))
        if not wanted:
            return items.where(says).drop("_block")
        own = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "g string").select(self._part(F.col("g"))).distinct().collect()]
        postings = self.spark.read.parquet(f"{self.path}/postings").where(F.col("_part").isin(own) & F.col("_gram").isin(wanted))
        held = postings.groupBy("_id", "_in").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted))
        return items.join(held, (items["_block"] == held["_in"]) & (items[self.id] == held["_id"]), "left_semi").where(says).drop("_block")
