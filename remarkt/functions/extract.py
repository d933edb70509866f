"""Device attributes from titles and descriptions, as column expressions.

compat keeps the behaviour listings have been read with so far: titles lose all Japanese before they are tagged, a
lone Pro Max becomes empty, a mentioned Face ID counts as broken, of colliding aliases the later wins.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """The one step that Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# --- guards: a pattern runs only where words stand that every match of it holds


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Normal form in lower case with single blanks; letters of other scripts that patterns of any case take for Latin ones become those. Beside nfkc it costs less than Spark's lower."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).replace("\u0130", "i").replace("\u0131", "i").lower().split()), na_action="ignore")


def holds(text: Column, words) -> Column:
    """Whether any of the words is in the text, in its own case."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def needs(pattern: str) -> list[str]:
    """Lower-case words of which each match holds one, from the literal pieces of the pattern's branches; none where a branch has no piece."""
    body, branches, piece, depth, i = re.sub(r"^\(\?\w+\)", "", pattern), [[""]], "", 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif c == "[":
            while body[i] != "]":
                i += 2 if body[i] == "\\" else 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            branches.append([])
        elif c in "*?{" and not depth:
            # what stands before may be missing
            branches[-1][-1:] = [x[:-1] for x in branches[-1][-1:]]
            i = body.index("}", i) if c == "{" else i
        elif c not in ".^$+|" and not depth:
            branches[-1][-1:] = [(branches[-1] or [""])[-1] + c]
            i += 1
            continue
        branches[-1].append("")
        i += 1
    found: list[str] = []
    for pieces in sorted(([x.lower() for x in own if x] for own in branches), key=len):
        if not pieces:
            return []
        if not any(w in x for x in pieces for w in found):
            found.append(max(reversed(pieces), key=len))
    return [w for w in found if not any(x != w and x in w for x in found)]


def fits(text: Column, low: Column, pattern: str) -> Column:
    """Whether the pattern fits the text, whose folded form is low."""
    words = needs(pattern)
    return holds(low, words) & text.rlike(pattern) if words else text.rlike(pattern)


# --- dictionaries


def aliases(words: dict[str, tuple[str, ...]], compat: bool) -> dict[str, str]:
    """Lower-case alias to name; of colliding aliases the later wins in compat mode, else the earlier."""
    found: dict[str, str] = {}
    for name, own in words.items():
        for alias in own:
            if compat:
                found[alias.lower()] = name
            else:
                found.setdefault(alias.lower(), name)
    return found


def any_of(words) -> str:
    return "|".join(re.sub(r"([.\\+*?\[\]^$(){}=!<>|:#\-])", r"\\\1", w) for w in words)


def trie(words) -> str:
    """A pattern shaped like the words' trie: one branch for each next character, the longest word first."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def shape(node: dict) -> str:
        branches = "|".join(any_of([c]) + shape(below) for c, below in sorted(node.items()) if c)
        return f"(?:{branches})" + ("?" if "" in node else "") if branches else ""

    return shape(root)


#: Characters inside which no word starts or ends; all others, Japanese ones too, are edges.
INSIDE = "A-Za-z0-9_"


def walked(text: Column, words: dict[str, tuple[str, ...]], compat: bool = True) -> Column:
    """Names of the dictionary words that a trie matcher finds in one walk over the text, in any case.

    It tries the longest word that starts where it stands and that an edge or the end follows, and goes on behind that
    edge, which starts no word itself. Where no word fits it passes one edge, or a whole run of other characters and
    the edge behind it. Each match of the pattern is one such step, so that the walk stays inside the JVM.
    """
    known = aliases(words, compat)
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    edge = f"(?:[^{INSIDE}]|\\z)"
    steps = F.regexp_extract_all(F.lower(text), F.lit(f"({trie(known)}){edge}|[{INSIDE}]++{edge}|[^{INSIDE}]"), F.lit(1))
    return F.transform(F.filter(steps, lambda w: w != ""), lambda w: table[w])


def tags(text: Column, words: dict[str, tuple[str, ...]], compat: bool = True) -> Column:
    """Names of all dictionary words in order: in compat mode those a trie matcher finds, else the longest at each place that is not inside a Latin word."""
    if compat:
        return walked(text, words)
    known = aliases(words, compat)
    longest = sorted(known, key=lambda a: (-len(a), a))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    found = F.regexp_extract_all(text, F.lit(f"(?iu)(?<![{INSIDE}])(?:{any_of(longest)})(?![{INSIDE}])"), F.lit(0))
    return F.transform(found, lambda w: table[F.lower(w)])


def first(items: Column) -> Column:
    return F.when(F.size(items) > 0, items[0])


def present(text: Column, words) -> Column:
    """Whether any of the words is in the text, in its own case."""
    return F.coalesce(holds(text, words), F.lit(False))


def affirmed(text: Column, words, window: int, ahead: bool = False, negations=config.NEGATIONS, low: Column | None = None) -> Column:
    """Whether some word of the list stands without a negation in the so many characters after it (before it: ahead). low: the folded text, if a column has it."""
    named = holds(folded(text) if low is None else low, [w.lower() for w in words])
    if ahead:
        # the same, read from the end
        text, words, negations = F.reverse(text), [w[::-1] for w in words], [n[::-1] for n in negations]
    latin = [n for n in negations if n.isascii()]
    other = [n for n in negations if not n.isascii()]
    no = "(?iu)" + "|".join([*([any_of(other)] if other else []), *(f"(?<![A-Za-z0-9_]){any_of([n])}(?![A-Za-z0-9_])" for n in latin)])
    near = F.regexp_extract_all(text, F.lit(f"(?isu)(?>{any_of(words)})(?=(.{{0,{window}}}))"), F.lit(1))
    return F.coalesce(F.when(named, F.exists(near, lambda w: ~w.rlike(no))), F.lit(False))


# --- titles

def clean_title(title: Column, compat: bool = True) -> Column:
    whole = F.coalesce(title.cast("string"), F.lit(""))
    text, low = nfkc(whole), folded(whole)
    only = lambda words, change, text: F.when(holds(low, words), change).otherwise(text)
    text = F.regexp_replace(text, config.DECORATION, " ")
    text = F.regexp_replace(text, config.EMOJI_COMPAT if compat else config.EMOJI, " ")
    text = only(("http", "www"), F.regexp_replace(text, r"(?U)http\S+|www\S+", ""), text)
    plain = reduce(lambda x, word: F.regexp_replace(x, f"(?iu){word}", " "), config.SPAM, text)
    text = only([w for word in config.SPAM for w in needs(word)], plain, text)
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    names = ("iPhone", "Galaxy", "Pixel", "Xperia")
    return only([n.lower() for n in names], reduce(lambda x, name: F.regexp_replace(x, rf"(?iU)\b{name}\b", name), names, text), text)


def model(text: Column) -> Column:
    """(line, number): the first line whose pattern matches; null where none does."""
    found = F.lit(None).cast("struct<line: string, number: string>")
    for name, pattern in reversed(config.LINES):
        found = F.when(text.rlike(pattern), F.struct(F.lit(name).alias("line"), F.trim(F.regexp_extract(text, pattern, 1)).alias("number"))).otherwise(found)
    return found


def sizes(text: Column, pattern: str = config.SIZE) -> Column:
    """(gb, label) of each size in the text, which is searched once."""
    unit = lambda m: F.when(F.regexp_extract(m, pattern, 2).isin("GB", "gb", "ギガ"), "GB").otherwise("TB")
    number = lambda m: F.regexp_extract(m, pattern, 1).try_cast("bigint")
    # every pattern of sizes ends in one of these
    found = F.when(holds(text, ("GB", "gb", "TB", "tb", "ギガ", "テラ")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda m: F.struct((number(m) * F.when(unit(m) == "TB", 1024).otherwise(1)).alias("gb"), F.concat(number(m).cast("string"), unit(m)).alias("label")))


def largest(found: Column) -> Column:
    """The label of the largest; of equal ones the first, null without any. The array stands here once: lambdas would find it anew for each element."""
    return F.array_max(F.transform(found, lambda x, i: F.struct(x["gb"].alias("gb"), (-i).alias("i"), x["label"].alias("label"))))["label"]


def smallest(found: Column) -> Column:
    return F.array_min(F.transform(found, lambda x, i: F.struct(x["gb"].alias("gb"), i.alias("i"), x["label"].alias("label"))))["label"]


def capacity(text: Column) -> Column:
    """Of several sizes the largest is the storage, whether or not it reaches 32 GB."""
    return largest(sizes(text))


def ram(text: Column) -> Column:
    return smallest(F.filter(sizes(text, r"(?U)(\d+)\s*(GB|gb|ギガ)"), lambda x: x["gb"] <= 24))


def variant(found: Column, compat: bool = True) -> Column:
    """Unlike tags of variants as one text; null without any."""
    text = F.array_join(F.array_distinct(found), " ")
    if compat:
        swapped = F.trim(F.replace(F.replace(text, F.lit("Pro Max"), F.lit("")), F.lit("Pro"), F.lit("Pro Max")))
        text = F.when(text.contains("Pro Max"), F.regexp_replace(swapped, r"\s+", " ")).otherwise(text)
    return F.when(F.size(found) > 0, text)


def title_features(df: DataFrame, title: str = "name", compat: bool = True) -> DataFrame:
    """df and the title's features; columns of those names are replaced. What is used twice is a column first, so that no pattern runs again."""
    text = F.col("_title")
    kept = {"_model": model(text), "_brands": tags(text, config.BRANDS, compat), "_variants": tags(text, config.VARIANTS, compat), "_colors": tags(text, config.COLORS, compat)}
    line, number = F.col("_model.line"), F.col("_model.number")
    brand = F.coalesce(first(F.col("_brands")), F.create_map(*(F.lit(x) for p in config.BRAND_OF_LINE.items() for x in p))[line])
    new = {
        "original_title": F.coalesce(F.col(title).cast("string"), F.lit("")), "preprocessed_title": text, "brand": brand, "model_line": line, "model_number": number, "variant": variant(F.col("_variants"), compat),
        "color": first(F.col("_colors")), "ram": ram(text), "capacity": capacity(text),
    }
    return df.withColumn("_title", clean_title(F.col(title), compat)).withColumns(kept).withColumns(new).drop("_title", *kept)


# --- descriptions


def clean_description(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(text.cast("string"), F.lit(""))), r"(?U)\s+", " "), "^ | $", "")


def number_of(text: Column, pattern: str) -> Column:
    """The number that a pattern captures; a cast of no text at all costs an error inside."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).try_cast("int"))


def battery_percentage(text: Column) -> Column:
    # every pattern ends in a per cent sign
    return F.when(text.rlike("[%％]"), F.coalesce(*(number_of(text, p) for p in config.BATTERY)))


def description_ram(text: Column) -> Column:
    found = [number_of(text, p) for p in config.RAM]
    # every pattern has GB in any case
    return F.when(holds(text, ("GB", "gb", "Gb", "gB")), F.coalesce(*(F.when(n <= 24, F.concat(n.cast("string"), F.lit("GB"))) for n in found)))


def description_storage(text: Column) -> Column:
    return largest(F.filter(sizes(text), lambda x: x["gb"] >= 32))


def description_features(df: DataFrame, description: str = "explanation", compat: bool = True) -> DataFrame:
    """df and the description's features; columns of those names are replaced, and the description's blanks become null."""
    text, low = F.col("_text"), F.col("_low")
    raw = F.nullif(F.trim(F.col(description).cast("string")), F.lit("")) if description in df.columns else F.lit(None).cast("string")
    complete = present(text, config.COMPLETE_SET)
    free = fits(text, low, "(?iu)SIM.*フリー|シムフリー|sim.*free|SIMロック.*解除")
    scratched, cracked = affirmed(text, config.SCRATCHES, 10, low=low), affirmed(text, config.CRACKS, 10, low=low)
    issues = present(text, config.JUNK)
    status = F.lit(None).cast("string")
    for name, pattern in reversed(config.RESTRICTIONS):
        status = F.when(fits(text, low, pattern), name).otherwise(status)
    plain_ram = description_ram(text)
    broken = {}
    for name, words in (("face", config.FACE_ID), ("touch", config.TOUCH_ID)):
        good = affirmed(text, words, 10, low=low)
        # compat: a mention that no negation follows counts as broken
        broken[name] = good if compat else text.rlike("(?iu)" + any_of(words)) & ~good
    works = lambda name, words: F.when(present(text, words), ~broken[name])
    new = {
        "preprocessed_explanation": text, "battery_percentage": battery_percentage(text),
        "battery_status": F.when(fits(text, low, "(?iu)バッテリー.*良好|battery.*good"), "good").when(fits(text, low, "(?iu)バッテリー.*劣化|battery.*degraded"), "degraded"),
        "battery_replaced": fits(text, low, "(?iu)バッテリー.*交換|battery.*replaced|battery.*changed"), "storage": description_storage(text),
        "ram": plain_ram if compat or "ram" not in df.columns else F.coalesce(plain_ram, F.col("ram")),
        "has_box": complete | affirmed(text, config.BOX, 12, low=low), "has_charger": complete | affirmed(text, config.CHARGER, 15, low=low), "has_cable": complete | affirmed(text, config.CABLE, 15, low=low), "has_earphones": affirmed(text, config.EARPHONES, 15, low=low),
        "accessories_complete": complete, "is_sim_free": free, "sim_lock_status": F.when(free, "unlocked").when(fits(text, low, "(?iu)SIMロック|sim.*lock"), "locked"), "network_restriction": status,
        "has_scratches": scratched, "screen_condition": F.when(cracked, "cracked").when(scratched, "scratched").otherwise("clean"), "body_condition": F.when(scratched, "used").otherwise("good"), "has_damage": cracked,
        "face_id_working": works("face", config.FACE_ID), "touch_id_working": works("touch", config.TOUCH_ID), "fully_functional": ~issues & ~broken["face"] & ~broken["touch"], "has_issues": issues,
        "original_explanation": raw, description: raw,
    }
    return df.withColumns({"_text": clean_description(raw), "_low": folded(F.coalesce(raw, F.lit("")))}).withColumns(new).drop("_text", "_low")
