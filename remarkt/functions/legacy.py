"""The older extractors: titles by patterns of which the last line counts, descriptions by affirmative before negative patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import extract

#: Any case, letters and blanks of all scripts; a dot is all but a line feed.
ANY, CASED = "(?iuUd)", "(?Ud)"


def clean_title(title: Column) -> Column:
    """As titles are cleaned now, but what stands in lenticular brackets goes whole."""
    return extract.clean_title(F.regexp_replace(extract.nfkc(F.coalesce(title.cast("string"), F.lit(""))), "【[^】]*】", " "))


def brand(text: Column, low: Column) -> Column:
    """The brand whose word comes first, as a token: no letter of its own script stands beside it."""
    words = {w: name for name, own in config.OLD_BRANDS.items() for w in own}
    latin, kana = ([w for w in words if w.isascii() is ascii_] for ascii_ in (True, False))
    pattern = f"(?iu)(?<![A-Za-z0-9])(?:{extract.any_of(latin)})(?![A-Za-z0-9])|(?<![ァ-ヶー])(?:{extract.any_of(kana)})(?![ァ-ヶー])"
    names = F.create_map(*(F.lit(x) for w, name in words.items() for x in (w.lower(), name)))
    return F.when(extract.holds(low, [w.lower() for w in words]), names[F.lower(F.regexp_extract(text, pattern, 0))])


def model(text: Column, low: Column) -> Column:
    """(line, number) of the last line whose pattern fits."""
    found = F.lit(None).cast("struct<line: string, number: string>")
    for name, pattern in config.OLD_LINES:
        found = F.when(extract.fits(text, low, ANY + pattern), F.struct(F.lit(name).alias("line"), F.trim(F.regexp_extract(text, ANY + pattern, 1)).alias("number"))).otherwise(found)
    return found


def title_features(df: DataFrame, title: str = "name") -> DataFrame:
    """df and brand, model_line, model_number, variant, color, ram and capacity of the title, as the older extractor has them; columns of those names are replaced."""
    text, low = F.col("_title"), F.col("_low")
    variants = F.filter(F.array(*(F.when(extract.fits(text, low, ANY + p), name) for name, p in config.OLD_VARIANTS)), lambda v: v.isNotNull())
    color = F.coalesce(*(F.when(low.contains(w.lower()) & F.lower(text).contains(w.lower()), name) for w, name in config.OLD_COLORS))
    line = F.col("_model.line")
    of_line = F.create_map(*(F.lit(x) for pair in config.OLD_BRAND_OF_LINE.items() for x in pair))
    new = {
        "brand": F.coalesce(brand(text, low), of_line[line]), "model_line": line, "model_number": F.col("_model.number"), "variant": F.when(F.size(variants) > 0, F.array_join(variants, " ")), "color": color,
        "ram": extract.ram(text), "capacity": extract.capacity(text),
    }
    # words of the clean title stand in the folded one too: what is cleaned away leaves blanks
    whole = df.withColumns({"_title": clean_title(F.col(title)), "_low": extract.folded(F.col(title).cast("string"))}).withColumn("_low", F.coalesce("_low", F.lit("")))
    return whole.withColumn("_model", model(text, low)).withColumns(new).drop("_title", "_low", "_model")


def first_of(text: Column, low: Column, cases) -> Column:
    return F.coalesce(*(F.when(extract.fits(text, low, ANY + p), F.lit(value)) for p, value in cases))


def description_features(df: DataFrame, description: str = "explanation") -> DataFrame:
    """df and what the older extractor reads from the description; columns of those names are replaced."""
    text, low = F.col("_text"), F.col("_low")
    flags = {name: extract.fits(text, low, ANY + p) for name, p in config.OLD_FLAGS.items()}
    firsts = {name: first_of(text, low, cases) for name, cases in config.OLD_FIRST.items()}
    firsts |= {name: F.coalesce(firsts[name], F.lit(False)) for name in ("has_damage", "has_issues")}
    large = F.filter(extract.sizes(text), lambda x: x["gb"] >= 32)
    ram = [extract.number_of(text, CASED + p) for p in config.OLD_RAM]
    locked = F.when(F.col("is_sim_free"), "unlocked").when(extract.fits(text, low, ANY + "SIMロック|sim.*lock"), "locked")
    new = {
        "battery_percentage": extract.battery_percentage(text), "storage": F.when(F.size(large) > 0, extract.largest(large)),
        "ram": F.when(extract.holds(text, ("GB", "gb")), F.coalesce(*(F.when(n <= 24, F.concat(n.cast("string"), F.lit("GB"))) for n in ram))),
    }
    both = df.withColumns({"_text": extract.clean_description(F.col(description)), "_low": extract.folded(F.coalesce(F.col(description).cast("string"), F.lit("")))})
    return both.withColumns(flags | firsts | new).withColumn("sim_lock_status", locked).drop("_text", "_low")
