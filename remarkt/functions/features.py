"""The price model's features as one native projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .scalars import first_number

DEFAULTS = {"has_box": False, "has_charger": False, "is_sim_free": True, "fully_functional": True, "has_scratches": False, "has_damage": False, "has_issues": False}


def lookup(value: Column, table: dict[str, int], default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v))))[value], F.lit(float(default)))


def full_model_name(line: Column, number: Column, variant: Column) -> Column:
    """Parts with single blanks between, empty ones leaving theirs; the literals None and nan go."""
    text = F.concat(F.coalesce(line, F.lit("")), F.lit(" "), F.coalesce(number, F.lit("")), F.lit(" "), F.coalesce(variant, F.lit("")))
    return F.trim(F.replace(F.replace(text, F.lit("None"), F.lit("")), F.lit("nan"), F.lit("")))


def release_year(name: Column, years: dict[str, int], longest_first: bool = False, default: int = config.DEFAULT_YEAR) -> Column:
    """The year of the first model of the dictionary that the name holds; in its order, or the longest first."""
    if not years:
        return F.lit(float(default))
    import re

    keys = sorted(years, key=lambda k: -len(k)) if longest_first else list(years)
    pattern = "(?i)(" + "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", k) for k in keys) + ")"
    table = F.create_map(*(F.lit(x) for k, v in years.items() for x in (k.lower(), float(v))))
    return F.coalesce(table[F.lower(F.regexp_extract(name, pattern, 1))], F.lit(float(default)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def engineer(df: DataFrame, years: dict[str, int] | None = None, current_year: int = config.CURRENT_YEAR, terabytes: bool = False) -> DataFrame:
    """df (model_line, model_number, variant, condition, battery_percentage, screen_condition, body_condition, storage, ram, platform and flags, any of which may be absent) with the model's inputs but model_base_price.

    terabytes reads 1TB as 1024 and not as 1.
    """
    have = lambda name, kind="string": F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    d = df.withColumns({n: have(n) for n in ("model_line", "model_number", "variant", "condition", "screen_condition", "body_condition", "storage", "ram", "platform")} | {"battery_percentage": F.coalesce(F.nanvl(have("battery_percentage", "double"), F.lit(None).cast("double")), F.lit(80.0))})
    d = d.withColumns({n: F.coalesce(have(n, "boolean"), F.lit(v)).cast("int") for n, v in DEFAULTS.items()})
    d = d.withColumn("full_model_name", full_model_name(F.col("model_line"), F.col("model_number"), F.col("variant")))
    d = d.withColumn("release_year", release_year(F.col("full_model_name"), years or {}))
    gb = first_number(F.col("storage"), 64)
    if terabytes:
        gb = F.when(F.upper("storage").contains("TB"), gb * 1024).otherwise(gb)
    d = d.withColumns({
        "device_age_years": F.greatest(F.lit(float(current_year)) - F.col("release_year"), F.lit(0.0)), "condition_score": lookup(F.col("condition"), config.CONDITION_SCORES, 70),
        "battery_penalty": F.when(F.col("battery_percentage") < 80, (80 - F.col("battery_percentage")) * 0.5).otherwise(0.0), "screen_condition": F.coalesce("screen_condition", F.lit("clean")),
        "body_condition": F.coalesce("body_condition", F.lit("good")), "accessories_bonus": F.col("has_box") * 3.0 + F.col("has_charger") * 2.0 + F.col("has_box") * F.col("has_charger") * 5.0, "storage_gb": gb, "ram_gb": first_number(F.col("ram"), 4),
        "platform_encoded": lookup(F.col("platform"), config.PLATFORM_CODES, 1),
    })
    d = d.withColumns({"screen_penalty": lookup(F.col("screen_condition"), config.SCREEN_PENALTIES, 0), "body_penalty": lookup(F.col("body_condition"), config.BODY_PENALTIES, -2), "age_condition_interaction": F.col("device_age_years") * F.col("condition_score")})
    score = F.col("condition_score")
    d = d.withColumns({"battery_score": clip(score - F.col("battery_penalty"), 0, 100), "screen_score": clip(score + F.col("screen_penalty"), 0, 100), "body_score": clip(score + F.col("body_penalty"), 0, 100)})
    d = d.withColumn("quality_score", clip(F.col("battery_score") * 0.4 + F.col("screen_score") * 0.3 + F.col("body_score") * 0.2 + score * 0.1 + F.col("accessories_bonus"), 0, 110))
    g = F.col("storage_gb")
    return d.withColumns({
        "storage_tier": F.when((g > 0) & (g <= 64), 1).when((g > 64) & (g <= 256), 2).when((g > 256) & (g <= 1024), 3).otherwise(2),
        "battery_storage": F.col("battery_score") * F.log1p(g), "quality_storage": F.col("quality_score") * F.log1p(g), "condition_accessories": score * (1 + F.col("accessories_bonus") / 10),
        "has_any_damage": F.greatest("has_scratches", "has_damage", "has_issues"), "damage_severity": F.when((F.col("screen_penalty") < -15) | (F.col("has_damage") == 1), 2).when(F.col("has_scratches") == 1, 1).otherwise(0),
        "functionality_score": F.col("fully_functional") * 20 + F.col("is_sim_free") * 10 - F.col("has_issues") * 15,
    })
