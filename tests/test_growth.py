"""What lets a query's time, memory or shuffle grow with its input alone."""

import collections
import gc
import math

from pyspark.sql import functions as F

from remarkt import queries
from remarkt.functions import scalars
from remarkt.operators import statistics
from remarkt.plans import models, training
from remarkt.sources import html

SF = "/root/testdata/sf0.001"
CARD = '<ul><li class="list"><a href="/i"><h2 class="name">n</h2></a></li></ul><dl class="m-goodsTable"><dt>Condition</dt><dd>B</dd></dl>'


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parses(plan: str) -> list[int]:
    return [line.count("parse(") for line in plan.split("\n") if "ArrowEvalPython" in line]


def test_a_page_is_parsed_once(spark):
    pages = spark.createDataFrame([(CARD,)], "html string")
    both = pages.select(html.detail(F.col("html"), "mercari"), html.listing_cards(F.col("html"), "mercari", "https://s.example"))
    assert parses(plan_of(both)) == [1]
    plan = plan_of(queries.QUERIES["marketplace_pages"](spark, SF))
    assert parses(plan) == [1, 1, 1] and plan.count("Exchange RoundRobinPartitioning") == 3


def test_trees_go_with_their_page():
    gc.collect()
    gc.disable()
    try:
        assert html.parts(CARD, "mercari")[0] == "B"
        assert not any(isinstance(x, html.Node) for x in gc.get_objects())
    finally:
        gc.enable()


def test_terms_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "B c"), (2, "a"), (None, "c c"), (None, None), (3, ""), (4, "c b")], "k bigint, t string")
    wants = {(1, "a", 2), (1, "b", 2), (1, "a b", 2), (1, "b a", 1), (2, "b", 1), (2, "c", 1), (2, "b c", 1), (2, "a", 1), (None, "c", 2), (None, "c c", 1), (4, "c", 1), (4, "b", 1), (4, "c b", 1)}
    found = training.term_counts(docs, "k", "t")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wants, key=str)
    # by more keys of several rows than are broadcast
    least, training.AGAIN = training.AGAIN, 1
    try:
        assert sorted(map(tuple, training.term_counts(docs, "k", "t").collect()), key=str) == sorted(wants, key=str)
    finally:
        training.AGAIN = least
    single = docs.where("k in (1, 3, 4)")
    assert "Exchange" not in plan_of(training.term_counts(single, "k", "t"))
    # a term's scores add up to its mean without their rows
    assert "hashpartitioning(k" not in plan_of(training.mean_weights(single, "k", "t"))


def test_pairs_are_made_of_words_that_a_keyword_can_hold(spark, monkeypatch):
    """With a small vocabulary, ties at its end, rare pairs, words of nearly all rows, null and repeated keys: as from counts of all terms."""
    texts = ["the a b c", "the a b", "the a c a c", "the B a", None, "", "the e e", "the f e", "x" * 5 + " the", "g the g the g the", "the a b", "the q a"]
    docs = spark.createDataFrame([(k if k % 5 else None if k else 1, t) for k, t in enumerate(texts)], "k bigint, t string").repartition(3)
    seen, plain = [], training.with_terms
    monkeypatch.setattr(training, "with_terms", lambda *a, **some: seen.append(some) or plain(*a, **some))
    every = training.term_counts(docs, "k", "t").cache()
    for n, least, most in ((3, 2, 0.6), (50, 1, 1.0)):
        bounds = {"terms": n, "least": least, "most": most}
        kept = training.vocabulary(every, docs, **bounds)
        wants = sorted(every.join(kept, "term").select("k", "term", (F.col("_tf") * F.col("_weight")).alias("score")).collect(), key=str)
        seen.clear()
        assert sorted(training.term_weights(docs, "k", "t", **bounds).collect(), key=str) == wants
        # none while words are counted, then those of few words
        assert seen and all(some.get("pairs") is False or some["among"] is not None for some in seen)
    assert sorted(training.likely_words(docs, "k", "t", 3, 2, 0.6)) == ["a", "b", "c", "e", "the"]
    # all of them where words are too many
    monkeypatch.setattr(training, "LIKELY", 1)
    assert sorted(training.term_weights(docs, "k", "t", **bounds).collect(), key=str) == wants
    assert training.keywords(docs.where("k > 100"), "k", "t").collect() == []


def test_pairs_are_made_of_words_that_a_mean_weight_can_hold(spark, monkeypatch):
    """Of null, empty and repeated keys too; the means are those of all terms."""
    docs = spark.createDataFrame([(1, "the a b"), (2, "the a b c"), (2, "the q"), (None, "a b"), (4, None), (5, ""), (None, "a x")], "k bigint, t string")
    bounds = {"terms": 3, "least": 2, "most": 0.5}
    known = training.vocabulary(training.term_counts(docs, "k", "t"), docs, **bounds)
    wants = {(r.term, round(r._all * r._weight / r._rows, 9)) for r in known.collect()}
    seen, plain = [], training.with_terms
    monkeypatch.setattr(training, "with_terms", lambda *a, **some: seen.append(some) or plain(*a, **some))
    assert {tuple(r) for r in training.mean_weights(docs, "k", "t", **bounds).collect()} == wants and ("a b" in {w for w, _ in wants})
    assert all(some.get("pairs") is False or sorted(some["among"]) == ["a", "b", "the"] for some in seen)


def test_quartiles_of_a_column_hold_no_values_in_one_task(spark):
    rows = [(float(i * i % 101),) for i in range(1000)] + [(None,)]
    df = spark.createDataFrame(rows, "v double").repartition(3)
    assert "percentile(" not in plan_of(statistics.describe(df, "v"))
    got, v = statistics.describe(df, "v").first(), sorted(x for (x,) in rows[:-1])
    at = lambda q: v[int(q * 999)] + (q * 999 % 1) * (v[int(q * 999) + 1] - v[int(q * 999)])
    assert (got.n, got.low, got.high) == (1000, v[0], v[-1]) and [got.q1, got.median, got.q3] == [at(0.25), at(0.5), at(0.75)]
    none = statistics.describe(df.where("v is null"), "v").first()
    assert none.n == 0 and none.q1 is None and none.median is None
    odd = statistics.describe(spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (float("nan"),), (float("nan"),)], "v double"), "v").first()
    assert odd.q1 == 2.0 and math.isnan(odd.median) and math.isnan(odd.q3)


def test_n_grams_are_made_for_few_rows_in_many_tasks_and_counted_once(spark, monkeypatch):
    """The trees' vectors come from kept counts, not from texts."""
    seen = {}
    monkeypatch.setattr(models.boosting, "fit", lambda df, *a: seen.update(plan=plan_of(df), tasks=df.rdd.getNumPartitions()))
    monkeypatch.setattr(models.JunkModel, "predict", lambda self, df: df.withColumn("junk_probability", F.lit(0.0)))
    queries.QUERIES["junk_model"](spark, SF)
    assert seen["tasks"] == 4 * spark.sparkContext.defaultParallelism and "InMemoryTableScan" in seen["plan"]


def test_n_grams_are_made_once_for_an_unlike_word(spark, monkeypatch):
    """The counts of those of each text, without a list of them for each text."""
    texts = [("Aa aA bcdefg", "ÄB x"), (None, None), (" ", ""), ("x " * 50, "x😀yz"), ("bcd", "aa bcd")]
    df = spark.createDataFrame(texts, "name string, explanation string").withColumn("price", F.lit("7")).repartition(2)
    grams = [r.g for r in df.select(models.char_ngrams(F.concat_ws(" ", "name", "explanation")).alias("g")).collect()]
    totals = collections.Counter(x for g in grams for x in g)
    terms = models.top_terms(models.junk_inputs(df), 20)
    assert terms == sorted(totals, key=lambda x: (-totals[x], x))[:20]
    found = models.term_counts(models.junk_inputs(df), terms)
    got = [{terms[i]: v for i, v in zip(r._tf.indices.tolist(), r._tf.values.tolist(), strict=True)} for r in found.select("_tf").collect()]
    wants = [{x: n for x, n in collections.Counter(g).items() if x in terms} for g in grams]
    assert sorted(map(sorted, (x.items() for x in got))) == sorted(map(sorted, (x.items() for x in wants)))
    # a text's own n-grams are no column of the trees' plan
    seen = {}
    monkeypatch.setattr(models.boosting, "fit", lambda df, *a: seen.update(plan=plan_of(df)))
    models.train_junk(df.withColumn("is_junk", F.col("name").isNull()), terms=20)
    assert "_grams" not in seen["plan"] and "_words" in seen["plan"]


def test_a_load_finds_its_selection_once_for_the_status(spark):
    """One rank of the rows of a link, in a shuffle that carries no column that nothing reads."""
    plan = plan_of(queries.QUERIES["etl_again_status"](spark, SF))
    assert plan.count("FileScan parquet") <= 6 and "SortAggregate" not in plan
    ranked = [line for line in plan.split("\n") if " Window [" in line]
    assert len(ranked) == 1 and "WindowGroupLimit" in plan
    assert "min_by" not in plan


def test_a_price_is_read_with_few_patterns(spark):
    """Filters don't share them, so each stands for a pass over the text; the values are those of its digits."""
    texts = [None, "", " ", "YEN", "0", "000", "¥0,098 円", "a1b2", "3000000", "3000001", "0003000001", "1,234,567", "12,34567,89", "5000 YEN", "１２", "-7.5", "0\n12\n0", "9" * 400, "00" + "7" * 30]
    df = spark.createDataFrame([(x,) for x in texts], "p string").coalesce(1)

    def wants(x):
        d = "".join(c for c in x or "" if c in "0123456789").lstrip("0")
        return (float(d[:6]) if len(d) > 6 and int(d) > 3000000 else float(d)) if d else None

    assert [r.v for r in df.select(scalars.clean_price(F.col("p")).alias("v")).collect()] == [wants(x) for x in texts]
    plan = df.where(scalars.clean_price(F.col("p")).between(1, 9))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 10
