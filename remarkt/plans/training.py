"""The price model's training rows, from the lake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config, schema
from ..functions import scalars
from ..operators import rows, statistics

PLATFORMS = {"mercari": "Mercari", "rakuma": "Rakuma", "yahooauction": "YahooAuction"}


def first_present(df: DataFrame, names: Sequence[str], default: str):
    """The first value that isn't null of those columns that are there, else the default."""
    return F.coalesce(*(F.col(n).cast("string") for n in names if n in df.columns), F.lit(default))


def training_rows(raw: DataFrame, order: Sequence[str] = ("link",)) -> DataFrame:
    """Listings with a price in bounds, a brand (or Unknown where most lack one) and their ecosystem; of equal name, price and source the first."""
    df = raw.withColumns({"condition": first_present(raw, ("item_condition", "condition", "grade"), "B"), "price": scalars.numeric_price(F.col("price"))})
    df = schema.ensure_columns(df, schema.RAW_ITEMS)
    names = F.create_map(*(F.lit(x) for p in PLATFORMS.items() for x in p))
    df = df.withColumn("platform", F.coalesce(names[F.lower("source")], scalars.platform(F.col("link")), F.lit("Mercari")))
    df = statistics.fill_or_drop(df.where(F.col("price").between(config.MIN_PRICE, config.MAX_PRICE)), "brand", "Unknown")
    df = rows.keep_first(df, ["name", "price", "source"], order)
    return df.withColumns({"ecosystem": scalars.ecosystem(F.col("brand")), "storage": F.coalesce("storage", "capacity")})


def product_baseline(listings: DataFrame, key: str = "product_id") -> DataFrame:
    """Of each product the median battery and the most frequent condition and flags of its listings."""
    modes = ("condition_rank", "screen_condition", "body_condition", "platform")
    flags = ("has_box", "has_charger", "is_sim_free", "fully_functional", "has_scratches", "has_damage", "has_issues")
    found = listings.groupBy(key).agg(F.median("battery_percentage").alias("battery_percentage"), *(F.mode(c, True).alias(c) for c in modes if c in listings.columns), *(F.coalesce(F.mode(c, True), F.lit(False)).alias(c) for c in flags if c in listings.columns))
    return found.withColumnsRenamed({"condition_rank": "condition"})


#: Keys of several rows that are broadcast; more are joined by a shuffle.
AGAIN = 1 << 16


#: Words that a plan names to bound the pairs made of them; of more, all pairs are made.
LIKELY = 1 << 12


def with_terms(df: DataFrame, key: str, text: str, pairs: bool = True, among: Sequence[str] | None = None, known: Sequence[str] | None = None) -> DataFrame:
    """key and the sorted words and pairs of neighbours of each row's text: without pairs, of among's words alone, or known terms alone."""
    words = F.expr(r"regexp_extract_all(lower(coalesce(_text, '')), '[a-z0-9_]+', 0)")
    one = df.select(F.col(key).alias(key), F.col(text).alias("_text")).select(key, words.alias("_w"))
    own = lambda x, some: F.lit(True) if some is None else x.isin(list(some))
    terms = F.filter("_w", lambda w: own(w, among))
    if pairs:
        # behind the last word there is none, so that its pair is null
        after = F.zip_with("_w", F.slice("_w", 2, F.size("_w")), lambda a, b: F.when(own(a, among) & own(b, among), F.concat(a, F.lit(" "), b)))
        terms = F.concat(terms, F.array_compact(after))
    return one.select(key, F.sort_array(F.filter(terms, lambda t: own(t, known))).alias("_s"))


def term_counts(df: DataFrame, key: str, text: str, **some) -> DataFrame:
    """key, term and _tf for each term of a key, or some of with_terms. A row's terms are counted in the row; those of keys with several rows, which are looked for first, by a shuffle."""
    again = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    few = again.limit(AGAIN + 1).count()
    own = df[key].eqNullSafe(F.col("_key"))
    if few:
        again = F.broadcast(again) if few <= AGAIN else again
        several = with_terms(df.join(again, own, "left_semi"), key, text, **some).select(key, F.explode("_s").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("_tf"))
        df = df.join(again, own, "left_anti")
    # where a run of equal terms starts, and how far the next start is; a filter on terms, also that inferred from inline, would find them once more
    first = F.when(F.size("_s") > 0, F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1))))))
    starts = with_terms(df, key, text, **some).select(key, "_s", first.alias("_f"))
    runs = F.transform("_f", lambda i, j: F.struct(F.element_at("_s", i).alias("term"), (F.coalesce(F.get("_f", j + 1), F.size("_s") + 1) - i).cast("bigint").alias("_tf")))
    single = starts.select(key, F.inline_outer(runs)).where("term is not null")
    return single.unionByName(several) if few else single


def term_totals(counts: DataFrame, df: DataFrame) -> DataFrame:
    """term, _df (its keys), _all (its occurrences) and _rows (of df)."""
    rows_ = df.agg(F.count(F.lit(1)).alias("_rows"))
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("_tf").alias("_all")).join(F.broadcast(rows_), how="cross")


def likely_words(df: DataFrame, key: str, text: str, terms: int = 500, least: int = 2, most: float = 0.8) -> list[str] | None:
    """The words that the vocabulary's terms can be made of; None if these are more than LIKELY.

    A pair is in no more keys than each of its words, and no more often. So a word less frequent than the last term of
    a vocabulary of words alone is in no term of the whole one, and pairs with it need not be made or counted.
    """
    totals = term_totals(term_counts(df, key, text, pairs=False), df).where(F.col("_df") >= least)
    last = most_frequent(totals, terms, least, most).agg(F.min("_all").alias("_last"), F.count(F.lit(1)).alias("_n"))
    near = totals.join(F.broadcast(last), how="cross").where((F.col("_n") < terms) | (F.col("_all") >= F.col("_last")))
    found = near.select("term").limit(LIKELY + 1).collect()
    return [r["term"] for r in found] if len(found) <= LIKELY else None


def most_frequent(totals: DataFrame, terms: int, least: int, most: float) -> DataFrame:
    """So many of the most frequent terms, of ties the smaller, that at least so many keys and at most such a share of all rows have."""
    return totals.where((F.col("_df") >= least) & (F.col("_df") <= most * F.col("_rows"))).orderBy(F.desc("_all"), "term").limit(terms)


def vocabulary(counts: DataFrame, df: DataFrame, terms: int = 500, least: int = 2, most: float = 0.8) -> DataFrame:
    """term, _all (its occurrences), _rows (of df) and _weight of the most frequent terms, of ties the smaller, that at least so many keys and at most such a share of all rows have."""
    return most_frequent(term_totals(counts, df), terms, least, most).select("term", "_all", "_rows", F.log((F.col("_rows") + 1) / (F.col("_df") + 1)).alias("_weight"))


def term_weights(df: DataFrame, key: str, text: str, **bounds: float) -> DataFrame:
    """key, term and score: frequency times inverse document frequency, as rows, of words and pairs of neighbours in a key's text.

    Null texts have none. Terms stay rows: the vocabulary, which is found first, is joined by broadcast of its bounded
    size, and a row's other terms go before its terms are sorted and counted.
    """
    known = vocabulary(term_counts(df, key, text, among=likely_words(df, key, text, **bounds)), df, **bounds)
    # merged in a task: a sort with a limit that ends a plan sends each task's first rows to the driver
    found = known.coalesce(1).collect()
    terms = [r["term"] for r in found]
    counts = term_counts(df, key, text, among=sorted({w for t in terms for w in t.split(" ")}), known=terms)
    return counts.join(F.broadcast(df.sparkSession.createDataFrame(found, known.schema)), "term").select(key, "term", (F.col("_tf") * F.col("_weight")).alias("score"))


def mean_weights(df: DataFrame, key: str, text: str, n: int = 30, **bounds: float) -> DataFrame:
    """The n terms of the highest mean score over all rows, of ties the smaller. A term's scores add up to its occurrences times its weight."""
    known = vocabulary(term_counts(df, key, text, among=likely_words(df, key, text, **bounds)), df, **bounds)
    return known.select("term", F.round(F.col("_all") * F.col("_weight") / F.col("_rows"), 9).alias("score")).orderBy(F.desc("score"), "term").limit(n)


def keywords(df: DataFrame, key: str, text: str, n: int = 5, **bounds: float) -> DataFrame:
    """Of each key its n terms of the highest score over 0, joined; of ties the smaller first. Keys without any give no row. A key has as many terms as the vocabulary at most."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "term"))), 1, n)
    return term_weights(df, key, text, **bounds).where("score > 0").groupBy(key).agg(F.transform(best, lambda x: x["term"]).alias("keywords"))
