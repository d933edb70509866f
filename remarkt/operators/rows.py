"""Operators on rows: keep-first, membership, insert-if-absent, upserts, latest values, samples, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given ascending order, which should be total; null keys are one key.

    Tasks keep one row for each key before the shuffle, so a hot key gathers nothing; of the columns only those move that are read later.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def spread(df: DataFrame, tasks: int = 4) -> DataFrame:
    """df dealt to so many tasks for each core: for work that takes long on few or small rows."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism)


def valid_links(df: DataFrame, link: str = "link") -> DataFrame:
    """Links trimmed; rows without one go."""
    return df.withColumn(link, F.trim(link)).where(F.length(link) > 0)


def absent_from(df: DataFrame, known: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key isn't in known (column other, or the same name)."""
    return df.join(known.select(F.col(other or key).alias(key)), key, "left_anti")


def present_in(df: DataFrame, known: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return df.join(known.select(F.col(other or key).alias(key)), key, "left_semi")


def insert_absent(table: DataFrame, new: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The table and, of new, the first row of each key that it lacks."""
    return table.unionByName(absent_from(keep_first(new, [key], order), table, key).select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """The table with new's rows (one for each key): known keys take the columns in update, others keep theirs; unknown keys come in whole."""
    old, fresh = table.alias("o"), new.select(*table.columns).alias("n")
    known, hit = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    taken = set(update)
    columns = [F.when(known & ~(hit & F.lit(c in taken)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in table.columns]
    return old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def merge_statistics(table: DataFrame, new: DataFrame, keys: Sequence[str], average: str = "avg_price", low: str = "min_price", high: str = "max_price", count: str = "listing_count", newest: Sequence[str] = ()) -> DataFrame:
    """Both tables' averages weighted by their counts, least and greatest values, and counts added; merging in any order gives the same.

    newest: columns that are new's where that has a value, else the table's. One aggregation reads each table once.
    """
    columns = [*keys, average, low, high, count, *newest]
    both = table.select(*columns, F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    total = F.sum(count)
    last = [F.expr(f"max_by(`{c}`, _new) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in newest]
    return both.groupBy(*keys).agg((F.sum(F.col(average) * F.col(count)) / total).alias(average), F.min(low).alias(low), F.max(high).alias(high), total.alias(count), *last)


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """For each key without nulls the last value that isn't null of each column, in the order of a column."""
    some = df.dropna(subset=list(keys))
    return some.groupBy(*keys).agg(*(F.expr(f"max_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns))


def modes(df: DataFrame, keys: Sequence[str], averages: dict[str, str], modes_of: dict[str, object]) -> DataFrame:
    """Averages (name: column) and most frequent values (column: default) of each key in one aggregation; of ties the smallest, the default where all are null."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(n) for n, c in averages.items()), *(F.coalesce(F.mode(c, True), F.lit(d)).alias(c) for c, d in modes_of.items()))


def digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))


def hash_share(key: Column, seed: int = 42) -> Column:
    """A number from 0 to 99 that depends on the key and seed alone."""
    return F.pmod(F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def split(df: DataFrame, key: str, train_percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; the same whatever the partitions."""
    share = hash_share(F.col(key), seed)
    return df.where(share < train_percent), df.where(share >= train_percent)


def stratified_split(df: DataFrame, key: str, label: str, train_percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split that takes exactly train_percent of each label (rounded), those first by a digest of label and key.

    Rows are counted by label and first three digits of the digest; only the bucket in which a label's cut falls is
    ranked, a 4096th of its rows, so no label is gathered in a task.
    """
    marked = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(label).cast("string"), F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = marked.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_l")
    cuts = counts.withColumns({"_before": F.sum("_n").over(own.orderBy("_c")) - F.col("_n"), "_cut": F.floor((F.sum("_n").over(own) * train_percent + 50) / 100)})
    placed = marked.join(cuts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    across = (F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_n") > F.col("_cut"))
    ranked = placed.where(across).withColumn("_rank", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    train = placed.where("_before + _n <= _cut").select(*df.columns).unionByName(ranked.where("_before + _rank <= _cut").select(*df.columns))
    return train, placed.where("_before >= _cut").select(*df.columns).unionByName(ranked.where("_before + _rank > _cut").select(*df.columns))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a digest of their key, the same whatever the partitions."""
    return df.orderBy(digest(F.col(key), seed), key).limit(n)


def without_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """What a cascading delete leaves: rows whose parent is there."""
    return present_in(child, parent, key)


def transition(df: DataFrame, loaded: DataFrame, dropped: DataFrame, now: Column, key: str = "link") -> DataFrame:
    """Status and processed_at of the rows whose key is in loaded or, else, in dropped."""
    outcome = loaded.select(key).distinct().withColumn("_to", F.lit("loaded_mysql")).unionByName(dropped.select(key).distinct().withColumn("_to", F.lit("dropped_etl")))
    return moved(df, outcome.groupBy(key).agg(F.max("_to").alias("_to")), now, key)


def moved(df: DataFrame, outcome: DataFrame, now: Column, key: str = "link") -> DataFrame:
    """Status and processed_at of the rows whose key is in outcome: each key once, and in _to its new status."""
    hit = F.col("_to").isNotNull()
    return df.join(outcome.select(key, "_to"), key, "left").withColumns({"status": F.coalesce("_to", "status"), "processed": F.when(hit, F.lit(True)).otherwise(F.col("processed")), "processed_at": F.when(hit, now).otherwise(F.col("processed_at"))}).select(*df.columns)


def reset_status(df: DataFrame, states: Sequence[str] = ("loaded_mysql", "dropped_etl")) -> DataFrame:
    """Rows in one of the states go back to extracted_layer2; processed stays."""
    return df.withColumn("status", F.when(F.col("status").isin(*states), F.lit("extracted_layer2")).otherwise(F.col("status")))


def price_changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], now: Column, every: bool = False) -> DataFrame:
    """Key, new values and time of the rows whose values differ from the old (null is a value); of all updated rows if every."""
    o, n = old.alias("o"), new.alias("n")
    differs = F.lit(every)
    for c in columns:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).where(differs).select(F.col(f"n.{key}").alias(key), *(F.col(f"n.{c}").alias(c) for c in columns), now.alias("record_time"))


def touch(df: DataFrame, now: Column, rate: float | None = None) -> DataFrame:
    """What an update sets: updated_at, and price_vnd of price_yen at a rate."""
    out = df.withColumn("updated_at", now)
    return out if rate is None else out.withColumn("price_vnd", F.when(F.col("price_yen").isNotNull(), F.round(F.col("price_yen") * rate)).otherwise(F.col("price_vnd")))
