"""Keyword search over the catalogue with prices by source and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rows, statistics

SEARCH = """
    SELECT p.url, p.source, p.name, COALESCE(h.price_yen, p.price_yen) AS price_yen, COALESCE(h.price_vnd, p.price_vnd) AS price_vnd, p.condition, COALESCE(h.record_time, p.created_at) AS created_at
    FROM {items} p LEFT JOIN {prices} h ON p.id = h.item_id
    WHERE p.name ILIKE concat('%', :keyword, '%')
    ORDER BY created_at DESC, p.url, price_yen
"""


def search(spark: SparkSession, items: DataFrame, prices: DataFrame, keyword: str) -> DataFrame:
    """Prices of the items whose name holds the keyword (% and _ are wildcards), newest first; the item's own where it has no history."""
    return spark.sql(SEARCH, args={"keyword": keyword}, items=items, prices=prices)


def current(found: DataFrame) -> DataFrame:
    """The latest values of each item."""
    filled = found.fillna({"price_yen": 0, "price_vnd": 0, "condition": "Unknown"})
    return rows.latest(filled, ["source", "condition", "name", "url"], "created_at", ["price_yen", "price_vnd", "created_at"])


def report(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics by source, condition and over all, and quartiles by both."""
    now = current(found)
    return statistics.grouped_statistics(now, "price_vnd", "source", "condition"), statistics.box_plot(now, "price_vnd", "source", "condition")


def payload(found: DataFrame) -> DataFrame:
    """One JSON text with the statistics."""
    stats, _ = report(found)
    return stats.agg(F.to_json(F.sort_array(F.collect_list(F.struct("level", "source", "condition", "min_price", "max_price", "avg_price", "n")))).alias("json"))
