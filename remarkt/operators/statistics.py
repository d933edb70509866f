"""Aggregations: price statistics, profiles, counts, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks


def price_history(df: DataFrame, key: str, price: str, original: str | None = None) -> DataFrame:
    """Average, least, greatest price and listings of each product."""
    more = [F.avg(original).alias("original_price")] if original else []
    return df.groupBy(key).agg(F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.count(price).alias("listing_count"), *more)


def grouped_statistics(df: DataFrame, price: str, *groups: str) -> DataFrame:
    """Least, greatest, average price and rows by each group column and over all, in one pass of grouping sets; level names the set."""
    sets = [[g] for g in groups] + [[]]
    level = F.lit("all")
    for g in groups:
        level = F.when(F.grouping(g) == 0, F.lit(g)).otherwise(level)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(g) for g in groups)).agg(level.alias("level"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.avg(price).alias("avg_price"), F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, price: str, *keys: str) -> DataFrame:
    """Exact quartiles, least and greatest of each key."""
    q = F.percentile(price, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.min(price).alias("low"), q.alias("q"), F.max(price).alias("high")).select(*keys, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, exact quartiles, least, greatest and standard deviation of a column; nulls don't count."""
    c = F.col(column)
    whole = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.stddev_samp(c).alias("std"))
    # a row on either side; percentile would hold all values in one task
    both = whole.join(ranks.quantiles(df, [], column, {"q1": 0.25, "median": 0.5, "q3": 0.75}), how="cross")
    return both.select("n", "mean", "q1", "median", "q3", "low", "high", "std")


def coverage(df: DataFrame) -> DataFrame:
    """column_name, non_null, share (percent) and n_true (booleans) of every column, in one aggregation."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in df.schema:
        yes = F.count_if(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.BooleanType) else F.lit(None).cast("bigint")
        aggs.append(F.struct(F.lit(f.name).alias("column_name"), F.count(F.col(f"`{f.name}`")).alias("non_null"), yes.alias("n_true")).alias(f"_{f.name}"))
    wide = df.agg(*aggs)
    rows = wide.select("_n", F.explode(F.array(*(F.col(f"`_{f.name}`") for f in df.schema))).alias("x"))
    return rows.select("x.column_name", "x.non_null", F.when(F.col("_n") > 0, 100.0 * F.col("x.non_null") / F.col("_n")).alias("share"), "x.n_true")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value that isn't null, most first; of ties the smaller value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def target_encoding(df: DataFrame, key: str, target: str, count: str | None = None) -> DataFrame:
    """Median target of each key, and the mean of those medians for keys that are new. count: how many rows each stands for."""
    each = df.groupBy(key).agg((F.percentile(target, 0.5, F.col(count)) if count else F.median(target)).alias("base_price"))
    return each, each.agg(F.avg("base_price").alias("fallback"))


def apply_encoding(df: DataFrame, each: DataFrame, fallback: DataFrame, key: str, name: str = "model_base_price") -> DataFrame:
    return df.join(each, key, "left").join(F.broadcast(fallback), how="cross").withColumn(name, F.coalesce("base_price", "fallback", F.lit(0.0))).drop("base_price", "fallback")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Of each label: precision, recall, F1 and rows."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.col("l").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hit"))
    )
    s = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumns({"precision": ratio(F.col("hit"), F.col("predicted")), "recall": ratio(F.col("hit"), F.col("support"))})
    return s.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def regression_metrics(df: DataFrame, target: str, prediction: str, count: str | None = None) -> DataFrame:
    """Mean absolute error and R2, from sums of one pass; of two where a column says how many rows each stands for."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    if count:
        n = F.when(y.isNotNull(), F.col(count))
        mean = df.agg((F.sum(n * y) / F.sum(n)).alias("_mean"))
        s = df.join(F.broadcast(mean), how="cross").agg((F.sum(n * F.abs(y - p)) / F.sum(n)).alias("mae"), F.sum(n * (y - p) ** 2).alias("left_over"), (F.sum(n * (y - F.col("_mean")) ** 2) / F.sum(n)).alias("v"), F.coalesce(F.sum(n), F.lit(0)).alias("n"))
    else:
        s = df.agg(F.avg(F.abs(y - p)).alias("mae"), F.sum((y - p) ** 2).alias("left_over"), F.var_pop(y).alias("v"), F.count(y).alias("n"))
    return s.select("mae", F.when(F.col("v") > 0, 1 - F.col("left_over") / (F.col("v") * F.col("n"))).alias("r2"), "n")


def error_bands(error_percent: Column) -> Column:
    return F.when(error_percent < 10, "under 10").when(error_percent < 20, "under 20").otherwise("20 and over")


def audit(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """df and drop_reason: the first step whose condition a row fails, null for rows that pass all."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(steps):
        reason = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(reason)
    return df.withColumn("drop_reason", reason)


def top_terms(df: DataFrame, terms: str, n: int = 30) -> DataFrame:
    """Mean score over all rows of each term of a map column, the n best."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    each = df.select(F.explode(terms).alias("term", "score")).groupBy("term").agg(F.sum("score").alias("s"))
    return each.join(F.broadcast(total), how="cross").select("term", (F.col("s") / F.col("_rows")).alias("score")).orderBy(F.desc("score"), "term").limit(n)


def top_keywords(scores: Column, n: int) -> Column:
    """The n best terms of a map of scores, positive ones only; of ties the smaller term."""
    pairs = F.transform(F.filter(F.map_entries(scores), lambda e: e["value"] > 0), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("t")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["t"])


def fill_or_drop(df: DataFrame, column: str, fill: str, most: float = 0.5) -> DataFrame:
    """Nulls of a column become fill where over most of the rows are null; else those rows go. Lazy: the share is one aggregated row."""
    share = df.agg(F.avg(F.col(column).isNull().cast("double")).alias("_nulls"))
    many = F.coalesce(F.col("_nulls") > most, F.lit(False))
    both = df.join(F.broadcast(share), how="cross")
    return both.where(F.col(column).isNotNull() | many).withColumn(column, F.coalesce(column, F.lit(fill))).drop("_nulls")


def described(df: DataFrame, column: str = "explanation") -> DataFrame:
    """Rows, and those whose description is neither blank nor the word nan."""
    text = F.trim(F.col(column).cast("string"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if((text != "") & (F.lower(text) != "nan")).alias("n_described"))


def completeness(df: DataFrame, specs: str = "base_specs") -> DataFrame:
    """Rows, and those whose JSON of specifications has a storage and a memory, with shares in percent."""
    has = lambda name: F.count_if(F.get_json_object(specs, f"$.{name}").isNotNull())
    found = df.agg(F.count(F.lit(1)).alias("n"), has("storage").alias("with_storage"), has("ram").alias("with_ram"))
    share = lambda c: F.when(F.col("n") > 0, F.round(100.0 * F.col(c) / F.col("n"), 1))
    return found.withColumns({"storage_share": share("with_storage"), "ram_share": share("with_ram")})
