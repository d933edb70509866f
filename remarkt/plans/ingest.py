"""From captured rows to the lake: valid links, no repeats, only what is new."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schema
from ..functions.extract import description_features, title_features
from ..operators.rows import absent_from, keep_first, valid_links


@dataclass
class Outcome:
    code: str
    received: int
    valid: int
    distinct: int
    inserted: int


def extract(raw: DataFrame, compat: bool = True) -> DataFrame:
    """Title features, then description features; with compat the description's ram replaces the title's even if null."""
    return description_features(title_features(raw, compat=compat), compat=compat)


def stamped(df: DataFrame, source: Column, now: Column) -> DataFrame:
    junk = F.coalesce(F.col("is_junk"), F.lit(False)) if "is_junk" in df.columns else F.lit(False)
    return df.withColumns({"source": source, "ingested_at": now, "status": F.lit("extracted_layer2"), "processed": F.lit(False), "is_junk": junk})


def new_rows(batch: DataFrame, lake: DataFrame, source: Column, now: Column, order: Column) -> DataFrame:
    """Rows to insert: the first of each valid link that the lake lacks, stamped."""
    return schema.nan_to_null(stamped(absent_from(keep_first(valid_links(batch), ["link"], [order]), lake, "link"), source, now))


def ingest(batch: DataFrame, lake: DataFrame, path: str, source: Column, now: Column, order: Column) -> Outcome:
    """Append the new rows at path; a second run of the same batch inserts none."""
    if "link" not in batch.columns:
        return Outcome("missing_link_column", batch.count(), 0, 0, 0)
    link = F.trim("link")
    found = F.when(F.length(link) > 0, link)
    received, valid, distinct = batch.agg(F.count(F.lit(1)), F.count(found), F.count_distinct(found)).first()
    if not received:
        return Outcome("empty_df", 0, 0, 0, 0)
    if not valid:
        return Outcome("no_valid_links", received, 0, 0, 0)
    rows = schema.conform(new_rows(batch, lake, source, now, order), schema.RAW_ITEMS)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    n = seen.get["n"]
    return Outcome("inserted" if n else "all_duplicates", received, valid, distinct, n)


#: Status of a source's run by its outcome code.
STATUS = {"empty_df": "WARNING", "no_valid_links": "WARN", "all_duplicates": "OK", "inserted": "SUCCESS"}


def ledger(batch: DataFrame, lake: DataFrame, sources: Sequence[str], column: str = "source") -> DataFrame:
    """A row for each source of a run: received rows, valid links, distinct ones, inserted rows (the lake lacks their link), code and status.

    Links are reduced to one row each, of the first source by name, before the lake is asked; sources that brought nothing have a row too, those that aren't listed have none.
    """
    spark = batch.sparkSession
    named = batch.where(F.col(column).isin(*sources))
    linked = valid_links(named).select(column, "link")
    counts = named.groupBy(column).agg(F.count(F.lit(1)).alias("received"))
    valid = linked.groupBy(column, "link").agg(F.count(F.lit(1)).alias("n")).groupBy(column).agg(F.sum("n").alias("valid"), F.count(F.lit(1)).alias("distinct"))
    first = linked.groupBy("link").agg(F.min(column).alias(column))
    new = absent_from(first, lake, "link").groupBy(column).agg(F.count(F.lit(1)).alias("inserted"))
    all_ = spark.createDataFrame([(x,) for x in sources], f"{column} string")
    # as many rows as sources on each side
    out = all_.join(counts, column, "left").join(valid, column, "left").join(new, column, "left").fillna(0)
    code = F.when(F.col("received") == 0, "empty_df").when(F.col("valid") == 0, "no_valid_links").when(F.col("inserted") == 0, "all_duplicates").otherwise("inserted")
    status = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return out.withColumn("code", code).withColumn("status", status[F.col("code")])
