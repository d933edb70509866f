"""Scalar functions on prices, links, flags and specifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def clean_price(price: Column) -> Column:
    """Yen of a price text: its digits; only the first six where two numbers ran together; null if there are none or they are 0."""
    # without leading zeros too: empty, so no number, where the price is 0
    plain = F.regexp_replace(price.cast("string"), "^[^1-9]+|[^0-9]", "")
    value = plain.try_cast("double")
    return F.when((value > config.GLUED_PRICE) & (F.length(plain) > 6), F.substring(plain, 1, 6).cast("double")).otherwise(value)


def positive(price: Column) -> Column:
    """A price that is a number already."""
    return F.when(price > 0, price.cast("double"))


def digits_or_zero(price: Column) -> Column:
    return F.coalesce(digits(price.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))


def numeric_price(price: Column) -> Column:
    """The training set's reading: signs of currency and commas go, what is then no number is null."""
    return F.regexp_replace(price.cast("string"), "¥|円|YEN|yen|,|\\s", "").try_cast("double")


def first_number(text: Column, default: float) -> Column:
    return F.coalesce(F.regexp_extract(text, "([0-9]+)", 1).try_cast("double"), F.lit(float(default)))


def platform(url: Column) -> Column:
    """The marketplace of a link, by the first that it names."""
    low = F.lower(url)
    return F.when(low.contains("mercari"), "Mercari").when(low.contains("rakuma") | low.contains("rakuten"), "Rakuma").when(low.contains("yahoo") | low.contains("jdirectitems"), "YahooAuction")


def normalize_link(href: Column, base: str) -> Column:
    """An absolute link: absolute ones stay, rooted and relative ones get the base's host; null if blank."""
    clean = F.replace(href, F.lit("/undefined"), F.lit(""))
    host = base.rstrip("/")
    scheme = host.split("//")[0]
    joined = (
        F.when(clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), clean)
        .when(clean.startswith("//"), F.concat(F.lit(scheme), clean))
        .when(clean.startswith("/"), F.concat(F.lit(host), clean))
        .when(clean == "", F.lit(host))
        .otherwise(F.concat(F.lit(host + "/"), clean))
    )
    return F.when(href != "", joined)


def description_link(url: Column, base: str) -> Column:
    """/rakuma/item/x to /rakuma/item/description/x on the base's host; null for other links."""
    item = F.regexp_extract(url, "/rakuma/item/([^?]*)", 1)
    item = F.regexp_replace(item, "^/+|/+$", "")
    return F.when(url.contains("/rakuma/item/") & (item != "") & ~item.contains("/"), F.concat(F.lit(base.rstrip("/") + "/rakuma/item/description/"), item))


def trim_lines(text: Column) -> Column:
    """Each line trimmed, empty ones gone; null if nothing is left."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def redact_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "//[^/@]*@", "//***:***@")


def is_condition_label(label: Column) -> Column:
    """Whether a label in a detail page names the item's condition."""
    words = F.trim(F.regexp_replace(label, r"(?U)\s+", " "))
    low = F.lower(words)
    skip = reduce(lambda a, b: a | b, (low.contains(s) for s in config.CONDITION_LABEL_SKIP))
    yes = low.contains("item condition") | (low == "condition") | reduce(lambda a, b: a | b, (words.contains(s) for s in config.CONDITION_LABEL_JP))
    return F.coalesce(~skip & yes, F.lit(False))


def as_flag(value: Column) -> Column:
    """A request's flag as 0 or 1: words for yes and no, else whether the whole part of a number is not 0."""
    s = F.lower(F.trim(value.cast("string")))
    number = F.coalesce(F.abs(s.try_cast("double")) >= 1, F.lit(False))
    return F.when(s.isNull() | s.isin("0", "false", "no", "", "off"), 0).when(s.isin("1", "true", "yes", "on"), 1).otherwise(number.cast("int"))


def as_boolean(value: Column) -> Column:
    """A request's boolean: words for no are false, any other text is true."""
    s = F.lower(F.trim(value.cast("string")))
    return F.coalesce(~s.isin("0", "false", "no", "off", ""), F.lit(False))


def joined(*parts: Column) -> Column:
    """Parts that are neither null nor empty, with blanks between."""
    return F.trim(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def standard_name(brand: Column, line: Column, number: Column, variant: Column, capacity: Column, storage: Column, raw: Column) -> Column:
    """A product's name from its parts; the first 100 characters of the raw name where that is under 5."""
    name = joined(brand, line, number, variant, F.coalesce(capacity, storage))
    return F.when((F.length(name) < 5) & raw.isNotNull(), F.substring(raw, 1, 100)).otherwise(name)


def base_specs(storage: Column, capacity: Column, ram: Column) -> Column:
    """JSON of storage and ram without GB, nulls written out."""
    bare = lambda c: F.trim(F.regexp_replace(c, "GB|gb", ""))
    return F.to_json(F.struct(bare(F.coalesce(storage, capacity)).alias("storage"), bare(ram).alias("ram")), {"ignoreNullFields": "false"})


def surrogate_key(*parts: Column) -> Column:
    """A key that a rerun gives again, instead of a random one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)).cast("binary"), 256), 1, 36)


def fingerprint(json_text: Column) -> Column:
    return F.substring(F.sha2(json_text.cast("binary"), 256), 1, 16)


def cache_key(product: Column, version: Column, mark: Column, grid: Column, fx: Column) -> Column:
    return F.format_string("depcurve:%s:%s:%s:%s:fx%s", product, version, mark, grid, fx.cast("string"))


def model_version(r2: Column, model: str = "smart_v1") -> Column:
    """A model's name with its R2, as forecasts store it (smart_v1) or as curves are cached by it (smart_v1.0)."""
    return F.format_string(model + "_r2_%.3f", r2)


def confidence(r2: Column) -> Column:
    return F.coalesce(r2 * 100, F.lit(50.0))


def ecosystem(brand: Column) -> Column:
    return F.when(F.lower(F.trim(brand)) == "apple", "Apple").otherwise("Android")


def junk_heuristic(name: Column, price: Column, description: Column) -> Column:
    """1 for what is no device: no name, a price below 3000, an accessory's name without a safe word, words of spare parts."""
    low, said, p = F.lower(name), F.lower(F.coalesce(description, F.lit(""))), digits_or_zero(price)
    return (
        F.when(name.isNull() | (F.trim(name) == ""), 1)
        .when((p > 0) & (p < 3000), 1)
        .when(low.rlike(config.JUNK_NAME) & ~low.rlike(config.JUNK_NAME_SAFE), 1)
        .when(said.rlike(config.JUNK_DESCRIPTION), 1)
        .otherwise(0)
    )
