"""Exact order statistics and modes of each key, of which no task holds a key's rows.

Values are counted by key first. Splitters of all values part the counts into ranges, so a key's values lie in as many
groups as there are ranges; running counts of a key's ranges and, inside a range, of its values give exact ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def splitters(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Values that part all rows into about equal ranges, by a sketch of bounded size; any would be right."""
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(value), shares, 10 * ranges).alias("s")).first()[0] or []
    # not-a-number has no place among bounds; it is above all of them
    return sorted({float(x) for x in found if x == x})


def range_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are under a value: a balanced tree of comparisons, so a row takes as many as the tree is deep."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > bounds[mid], below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(bounds))


def ranked(df: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """keys, value, count, rank (of its first row among the key's, from 0) and total (the key's rows), for values that aren't null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parted = counts.withColumn("_r", range_of(F.col("_v"), splitters(df, value, ranges)))
    ranges_of = parted.groupBy(*keys, "_r").agg(F.sum("_c").alias("_in"))
    # as many rows for a key as there are ranges
    own = Window.partitionBy(*keys)
    before = ranges_of.withColumns({"_before": F.sum("_in").over(own.orderBy("_r")) - F.col("_in"), "total": F.sum("_in").over(own)}).drop("_in")
    same = [parted[k].eqNullSafe(before[k]) for k in keys]
    joined = parted.join(before, [*same, parted["_r"] == before["_r"]])
    here = Window.partitionBy(*(parted[k] for k in keys), parted["_r"]).orderBy("_v")
    rank = F.col("_before") + F.sum("_c").over(here) - F.col("_c")
    return joined.select(*(parted[k] for k in keys), F.col("_v").alias("value"), F.col("_c").alias("count"), rank.alias("rank"), "total")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Of each key with a value that isn't null its exact quantiles, between two values in proportion; names to shares."""
    found, places = ranked(df, keys, value, ranges), {}
    near = F.lit(False)
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("total") - 1)
        # the values at the ranks on either side
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (F.col("rank") <= rank) & (rank < F.col("rank") + F.col("count"))
            places[f"{name}_{side}"] = F.max(F.when(covers, F.col("value"))).alias(f"{name}_{side}")
            near = near | covers
    ends = found.where(near).groupBy(*keys).agg(*places.values(), F.max("total").alias("_n"))

    def between(name: str, share: float) -> Column:
        at = F.lit(float(share)) * (F.col("_n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name)

    return ends.select(*keys, *(between(n, s) for n, s in shares.items()))


def modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key the most frequent value of each column, nulls aside, of ties the smallest; null where all are null.

    All columns' values are counted in one pass; a task keeps one value of a key and column before the last shuffle.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns))))
    counts = df.select(*keys, pairs.alias("x")).select(*keys, "x.i", "x.v").groupBy(*keys, "i", "v").agg(F.count("v").alias("n"))
    typed = {c: df.schema[c].dataType for c in columns}
    least = [F.min(F.when((F.col("i") == i) & F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("v").cast(typed[c]).alias("v"))))["v"].alias(c) for i, c in enumerate(columns)]
    return counts.groupBy(*keys).agg(*least)
