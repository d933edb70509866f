"""From the lake to products, listings, price history: one lazy plan for each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, schema
from ..functions import scalars
from ..operators import rows, statistics
from ..sources.tables import lake_selection

#: Columns that a known listing takes from a new one; the others keep what they have.
LISTING_UPDATES = (
    "price", "original_price", "condition_rank", "color", "description", "battery_health", "battery_percentage", "battery_status", "has_box", "has_charger", "is_sim_free", "screen_condition", "body_condition", "has_scratches",
    "fully_functional", "last_updated",
)


def prepared(raw: DataFrame, fx: float = config.YEN_TO_VND) -> DataFrame:
    """All rows of the selection with names, prices and specifications, and drop_reason of those that don't go on."""
    df = schema.ensure_columns(rows.keep_first(lake_selection(raw), ["link"], ["ingested_at", "source", "name", "price"]), schema.RAW_ITEMS)
    df = df.withColumnsRenamed({"link": "source_url", "name": "name_raw", "price": "price_raw", "condition": "condition_rank", "explanation": "description"})
    df = df.withColumns({"platform": scalars.platform(F.col("source_url")), "price_yen": scalars.clean_price(F.col("price_raw"))})
    c = F.col
    df = df.withColumns({
        "price_vnd": c("price_yen") * fx, "standard_name": scalars.standard_name(c("brand"), c("model_line"), c("model_number"), c("variant"), c("capacity"), c("storage"), c("name_raw")),
        "model_series": scalars.joined(c("model_line"), c("model_number")), "category": F.lit("Smartphone"), "base_specs": scalars.base_specs(c("storage"), c("capacity"), c("ram")),
    })
    return statistics.audit(df, [
        ("link", c("source_url").isNotNull()), ("platform", c("platform").isNotNull()), ("price", c("price_yen").between(config.MIN_PRICE, config.MAX_PRICE)), ("brand", c("brand").isNotNull()), ("name", c("standard_name").isNotNull()),
    ])


@dataclass
class Tables:
    products: DataFrame
    listings: DataFrame
    history: DataFrame
    raw: DataFrame
    audit: DataFrame


def load(raw: DataFrame, products: DataFrame, listings: DataFrame, history: DataFrame, now: Column, today: Column, fx: float = config.YEN_TO_VND) -> Tables:
    """The tables after a load, to be written as a new snapshot. A second load of the same lake changes nothing.

    Kept rows become loaded_mysql; filtered ones, and links that are listed already, dropped_etl.
    """
    all_ = prepared(raw, fx)
    clean = all_.where("drop_reason is null")
    new = rows.absent_from(clean, listings, "source_url")
    named = new.select(scalars.surrogate_key(F.col("standard_name")).alias("product_id"), F.col("standard_name").alias("name"), "brand", "model_series", "category", "base_specs", now.alias("created_at"), "source_url")
    products2 = rows.insert_absent(schema.conform(products, schema.PRODUCTS), named, "name", ["source_url"])
    # a name's key is that of the known product, else its hash, so the new products need not be made for it
    known = products.select(F.col("product_id").alias("_known"), F.col("name").alias("standard_name"))
    keyed = new.join(known, "standard_name", "left").withColumn("product_id", F.coalesce("_known", scalars.surrogate_key(F.col("standard_name")))).drop("_known")
    c = F.col
    flags = {n: F.coalesce(c(n), F.lit(n == "fully_functional")) for n in ("battery_replaced", "has_box", "has_charger", "has_cable", "has_earphones", "is_sim_free", "has_scratches", "has_damage", "fully_functional", "has_issues")}
    listed = keyed.withColumns(flags | {
        "listing_id": scalars.surrogate_key(c("source_url")), "price": c("price_vnd"), "original_price": c("price_yen"), "currency": F.lit("VND"), "description": F.coalesce("description", F.lit("")), "battery_health": c("battery_percentage"),
        "posted_at": c("ingested_at"), "last_updated": now,
    })
    listings2 = rows.upsert(schema.conform(listings, schema.LISTINGS), schema.conform(listed, schema.LISTINGS), "source_url", LISTING_UPDATES)
    day = statistics.price_history(keyed, "product_id", "price_vnd", "price_yen").withColumn("record_date", today)
    history2 = merge_history(history, day)
    # a link is in one row of the selection, so what becomes of it is known there
    listed_already = listings.select("source_url").distinct().withColumn("_known", F.lit(True))
    outcome = all_.select("source_url", "drop_reason").join(listed_already, "source_url", "left")
    outcome = outcome.select(c("source_url").alias("link"), F.when(c("drop_reason").isNull() & c("_known").isNull(), "loaded_mysql").otherwise("dropped_etl").alias("_to"))
    done = rows.moved(raw, outcome, now)
    return Tables(products2, listings2, history2, done, all_.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")))


def merge_history(history: DataFrame, day: DataFrame) -> DataFrame:
    """Averages of a product's day weighted by listings; the original price is the newer one's where there is one."""
    return schema.conform(rows.merge_statistics(history, day, ["product_id", "record_date"], newest=["original_price"]), schema.PRICE_HISTORY)
