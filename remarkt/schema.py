"""Schemas of the tables, and columns that may be absent."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(fields: str) -> T.StructType:
    """From names and types; Spark's own parser would need a session at import."""
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}
    found = []
    for name, kind, digits in re.findall(r"(\w+) (\w+)(?:\((\d+,\d+)\))?", fields):
        found.append(T.StructField(name, T.DecimalType(*map(int, digits.split(","))) if digits else kinds[kind]))
    return T.StructType(found)


RAW_ITEMS = _struct(
    "link string, name string, price string, condition string, explanation string, brand string, model_line string, model_number string, variant string, color string, ram string, capacity string, storage string,"
    "battery_percentage int, battery_status string, battery_replaced boolean, has_box boolean, has_charger boolean, has_cable boolean, has_earphones boolean, accessories_complete boolean, is_sim_free boolean, sim_lock_status string,"
    "network_restriction string, has_scratches boolean, screen_condition string, body_condition string, has_damage boolean, face_id_working boolean, touch_id_working boolean, fully_functional boolean, has_issues boolean,"
    "is_junk boolean, source string, ingested_at timestamp, status string, processed boolean, processed_at timestamp"
)
PRODUCTS = _struct("product_id string, name string, brand string, model_series string, category string, base_specs string, created_at timestamp")
LISTINGS = _struct(
    "listing_id string, product_id string, source_url string, platform string, price decimal(15,2), original_price decimal(15,2), currency string, condition_rank string, color string, description string, battery_health int,"
    "battery_percentage int, battery_status string, battery_replaced boolean, has_box boolean, has_charger boolean, has_cable boolean, has_earphones boolean, is_sim_free boolean, network_restriction string, screen_condition string,"
    "body_condition string, has_scratches boolean, has_damage boolean, fully_functional boolean, has_issues boolean, posted_at timestamp, last_updated timestamp"
)
PRICE_HISTORY = _struct("product_id string, record_date date, avg_price decimal(15,2), original_price decimal(15,2), min_price decimal(15,2), max_price decimal(15,2), listing_count bigint")
FORECASTS = _struct("product_id string, forecast_date date, predicted_price decimal(15,2), confidence_score decimal(5,2), model_version string, created_at timestamp")
CATALOG_ITEMS = _struct("id bigint, url string, source string, name string, price_yen decimal(12,2), price_vnd decimal(14,0), condition string, created_at timestamp, updated_at timestamp")
CATALOG_PRICES = _struct("item_id bigint, price_yen decimal(12,2), price_vnd decimal(14,0), record_time timestamp")
#: Declared by the reference schema and used by none of its jobs.
USERS = _struct("user_id string, username string, email string, password_hash string, role string, created_at timestamp, updated_at timestamp")
SUBSCRIPTIONS = _struct("subscription_id string, user_id string, plan string, start_date timestamp, end_date timestamp, status string")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df and typed nulls for the columns of schema that it lacks."""
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema in its order, cast; others go."""
    return ensure_columns(df, schema).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def select_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(n for n in names if n in df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in every floating column, and blank text null in every string column."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(F.trim(c) != "", c)
        out.append(c.alias(f.name))
    return df.select(*out)
