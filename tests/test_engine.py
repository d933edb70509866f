"""Hand-derived cases of the rules, and properties of the plans."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from remarkt import config, schema
from remarkt.functions import extract, features, scalars
from remarkt.operators import rows, statistics
from remarkt.plans import etl, ingest, models, search
from remarkt.sources import html, tables
from remarkt.streaming.incremental import run_new_files


def values(spark, column, items, kind="string"):
    """What column (of a function of F.col('x')) gives for each item."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_prices(spark):
    got = values(spark, scalars.clean_price, [None, "12000", "0", "5,000 YEN", "abc", "10,000円 + 500円", "3000000", "3000001", "0円", "9" * 40])
    assert got == [None, 12000, None, 5000, None, 100005, 3000000, 300000, None, 999999]
    assert values(spark, scalars.digits_or_zero, [None, "", "¥1,2", "x"]) == [0, 0, 12, 0]
    assert values(spark, scalars.numeric_price, ["¥1,200", "1 200円", "abc", None, "12yen"]) == [1200, 1200, None, None, 12]
    assert values(spark, scalars.positive, [1.5, 0.0, -1.0, None], "double") == [1.5, None, None, None]


def test_links_labels_and_flags(spark):
    base = "https://shop.example"
    assert values(spark, lambda c: scalars.normalize_link(c, base), ["/a/undefined", "https://x/y", "b", "", None]) == [f"{base}/a", "https://x/y", f"{base}/b", None, None]
    assert values(spark, lambda c: scalars.description_link(c, base), ["https://h/rakuma/item/q?x=1", "https://h/rakuma/item/a/b", "https://h/other", None]) == [f"{base}/rakuma/item/description/q", None, None, None]
    assert values(spark, scalars.platform, ["http://H/Mercari/1", "x/RAKUTEN", "x/jdirectitems/2", "x", None]) == ["Mercari", "Rakuma", "YahooAuction", None, None]
    assert values(spark, scalars.is_condition_label, ["Item  Condition", "condition", "Bidder condition", "商品の状態", "size", None]) == [True, True, False, True, False, False]
    assert values(spark, scalars.as_flag, ["0", "FALSE", "off", "", None, "yes", "1", "2.7", "0.4", "x"]) == [0, 0, 0, 0, 0, 1, 1, 1, 0, 0]
    assert values(spark, scalars.as_boolean, ["no", "0", "x", "true", None]) == [False, False, True, True, False]
    assert values(spark, scalars.trim_lines, [" a \n\n　b\t\n ", " \n ", None]) == ["a\nb", None, None]
    assert values(spark, scalars.redact_uri, ["db://me:pw@host/x", "db://host"]) == ["db://***:***@host/x", "db://host"]
    assert values(spark, scalars.ecosystem, [" apple", "Sony", None]) == ["Apple", "Android", "Android"]


@pytest.mark.parametrize(
    ("title", "line", "number"),
    [("iPhoneSE3 64GB", "iPhone", "SE3"), ("iPhone XS Max", "iPhone", "XS"), ("iPhone6s 16GB", "iPhone", "6"), ("Galaxy A56 5G", "Galaxy", "A56"), ("Galaxy Z Flip 5", None, None), ("Pixel 8a", "Pixel", "8a"), ("Xperia 5 IV", "Xperia", "5"), ("Redmi Note 14", "Redmi", "Note 14"), ("AQUOS sense8", "AQUOS", "sense8"), ("", None, None)],
)
def test_models(spark, title, line, number):
    df = spark.createDataFrame([(title,)], "name string")
    r = extract.title_features(df).first()
    assert (r.model_line, r.model_number) == (line, number)


def test_capacity_and_ram(spark):
    items = ["6GB/128GB", "16GB", "1TB 512GB", "128Gb", "32GB/64GB", None]
    assert values(spark, extract.capacity, items) == ["128GB", "16GB", "1TB", None, "64GB", None]
    assert values(spark, extract.ram, items) == ["6GB", "16GB", None, None, None, None]


def test_titles_in_both_modes(spark):
    df = spark.createDataFrame([("iPhone 13 ブラック 本体 ２５６ＧＢ 箱",), ("iPhone 14 Pro Max",), ("SAMSUNG galaxy S22 Sierra Blue Pro",), (None,)], "name string")
    a, b, c, d = extract.title_features(df).collect()
    assert (a.brand, a.color, a.capacity) == ("Apple", None, "256GB")
    assert (b.variant, c.brand, c.color, c.variant) == ("", "SAMSUNG", "Blue", "Pro")
    assert (d.preprocessed_title, d.brand, d.capacity) == ("", None, None)
    a, b, c, _ = extract.title_features(df, compat=False).collect()
    assert (a.color, b.variant, c.brand) == ("Black", "Pro Max", "Samsung")


def test_negation_window(spark):
    box = lambda c: extract.affirmed(c, config.BOX, 12)
    items = ["箱なし", "箱あり", "箱なし、元箱あり", "箱1234567890なし", "箱12345678901なし", "box NG", "box NGO", "", None]
    assert values(spark, box, items) == [False, True, True, False, True, False, True, False, False]
    assert values(spark, lambda c: extract.affirmed(c, config.BOX, 12, ahead=True), ["なし 箱", "箱なし"]) == [False, True]


def test_descriptions_in_both_modes(spark):
    text = "バッテリー最大容量 87%\nフルセット Face ID OK 傷あり SIMフリー 利用制限△ RAM 8GB 256GB"
    df = spark.createDataFrame([(text, "4GB"), ("Face ID NG ひび割れ", "4GB"), (None, "4GB")], "explanation string, ram string")
    a, b, c = extract.description_features(df).collect()
    assert (a.battery_percentage, a.storage, a.ram, a.has_box, a.has_cable, a.has_earphones, a.is_sim_free, a.sim_lock_status, a.network_restriction) == (87, "256GB", "8GB", True, True, False, True, "unlocked", "possible")
    assert (a.has_scratches, a.screen_condition, a.body_condition, a.face_id_working, a.touch_id_working, a.fully_functional) == (True, "scratched", "used", False, None, False)
    assert (b.screen_condition, b.has_damage, b.face_id_working, b.ram) == ("cracked", True, True, None)
    assert (c.explanation, c.screen_condition, c.fully_functional) == (None, "clean", True)
    a, b, _ = extract.description_features(df, compat=False).collect()
    assert (a.face_id_working, a.fully_functional, b.face_id_working, b.ram) == (True, True, False, "4GB")


def test_features(spark):
    df = spark.createDataFrame([("Good", 70.0, "clean", "good", True, True, "1TB", "iPhone", "13"), (None, None, "cracked", None, None, None, "0", None, None)], "condition string, battery_percentage double, screen_condition string, body_condition string, has_box boolean, has_charger boolean, storage string, model_line string, model_number string")
    a, b = features.engineer(df, {"iPhone 13": 2021, "iPhone 1": 2007}).collect()
    assert (round(a.quality_score, 6), a.storage_gb, a.storage_tier, a.release_year, a.device_age_years, a.full_model_name) == (77.6, 1, 1, 2021, 5, "iPhone 13")
    assert (b.battery_percentage, b.damage_severity, b.storage_tier, b.release_year, b.functionality_score, b.platform_encoded) == (80, 2, 2, 2020, 30, 1)
    assert features.engineer(df, terabytes=True).first().storage_gb == 1024
    tiers = features.engineer(spark.createDataFrame([(s,) for s in ("64", "65", "256", "1024", "2048")], "storage string")).collect()
    assert [r.storage_tier for r in tiers] == [1, 2, 2, 3, 2]


def test_modes_and_merge(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b"), (1, None), (2, None)], "k int, v string")
    assert {r.k: r.v for r in rows.modes(df, ["k"], {}, {"v": "none"}).collect()} == {1: "a", 2: "none"}
    part = lambda *r: spark.createDataFrame(list(r), "p int, avg_price double, min_price double, max_price double, listing_count bigint")
    a, b, c = part((1, 100.0, 90.0, 110.0, 2)), part((1, 40.0, 40.0, 40.0, 1)), part((1, 10.0, 5.0, 200.0, 3), (2, 1.0, 1.0, 1.0, 1))
    assert tuple(rows.merge_statistics(a, b, ["p"]).first()) == (1, 80.0, 40.0, 110.0, 3)
    one, other = (sorted(map(tuple, x.collect())) for x in (rows.merge_statistics(rows.merge_statistics(a, b, ["p"]), c, ["p"]), rows.merge_statistics(a, rows.merge_statistics(b, c, ["p"]), ["p"])))
    assert one == other


def test_keep_first_is_idempotent_and_changes_see_nulls(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 5), (4, None, 4)], "id int, k string, o int")
    once = rows.keep_first(df, ["k"], ["o"])
    assert sorted(r.id for r in once.collect()) == [2, 4] == sorted(r.id for r in rows.keep_first(once, ["k"], ["o"]).collect())
    old = spark.createDataFrame([(1, 5.0), (2, None), (3, None)], "id int, yen double")
    new = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "id int, yen double")
    now = F.lit("2026-01-01").cast("timestamp")
    assert [r.id for r in rows.price_changes(old, new, "id", ["yen"], now).collect()] == [3]
    assert rows.price_changes(old, new, "id", ["yen"], now, every=True).count() == 3
    touched = rows.touch(spark.createDataFrame([(10.4, 0.0), (None, 7.0)], "price_yen double, price_vnd double"), now, config.YEN_TO_VND_TRIGGER).collect()
    assert [r.price_vnd for r in touched] == [1872.0, 7.0]


CARDS = """<ul class="item-lists"><li class="list x"><a href="/i/1/undefined"><h2 class="name"> Phone &amp; box </h2><p class="price">5,000 YEN</p></a></li><li class="list"></li></ul>
<li class="itemCard"><a href="/a"></a><div class="itemCard__itemName">N</div><div class="g-priceDetails"><li class="g-priceDetails__item"><span class="g-title">Current Price</span><span class="g-price">1</span></li><li class="g-priceDetails__item"><span class="g-title">Buyout Price</span><span class="g-price">9</span></li></div></li>
<li class="itemCard"><a href="/b"></a><div class="g-priceDetails"><li class="g-priceDetails__item"><span class="g-title">Current Price</span><span class="g-price">2</span></li></div></li>
<li class="itemCard"><a href="/c"></a><div class="itemCard__fleamarket"></div><div class="g-priceDetails"><li class="g-priceDetails__item"><span class="g-title">Current Price</span><span class="g-price">3</span></li></div></li>"""
DETAIL = """<body><script>x</script><dl class="m-goodsTable"><dt>Size</dt><dd>L</dd><dt>Item condition</dt><dd> Good </dd></dl><p class="m-itemDetail__content">one<br>two</p>
<li class="itemDetail__list"><div class="itemDetail__listName">Item Condition<span class="tooltip-auc">?bidder</span></div><div class="itemDetail__listValue">Used</div></li></body>"""


def test_pages(spark):
    df = spark.createDataFrame([(CARDS,), (None,), ("",)], "html string")
    got = {k: [r.c for r in df.select(html.listing_cards(F.col("html"), k, "https://s.example").alias("c")).collect()] for k in html.KINDS}
    for kind in ("mercari", "rakuma"):
        assert [(c.link, c.name, c.price) for c in got[kind][0]] == [("https://s.example/i/1", "Phone & box", "5,000 YEN"), (None, None, None)]
    assert [(c.link[-1], c.price, c.price_type, c.listing_type) for c in got["yahooauction"][0]] == [("a", "9", "buyout", "auction"), ("c", "3", "fixed", "fleamarket")]
    assert got["mercari"][1:] == [[], []]
    page = spark.createDataFrame([(DETAIL,), ("<body><style>s</style>a<div>b</div></body>",), (None,)], "html string")
    found = page.select(html.detail_condition("html", "mercari").alias("a"), html.detail_condition("html", "yahooauction").alias("b"), html.detail_description("html", "mercari").alias("c")).collect()
    assert [tuple(r) for r in found] == [("Good", "Used", "one\ntwo"), (None, None, "a\nb"), (None, None, None)]
    both = page.select(html.detail(F.col("html"), "mercari").alias("d")).collect()
    assert [tuple(r.d) for r in both] == [("Good", "one\ntwo"), (None, "a\nb"), (None, None)]
    # a page is parsed once for both
    plan = page.select(html.detail(F.col("html"), "mercari").alias("d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("parse(") == 1
    assert [html.kind_of_price(x) for x in ("Buyout Price", "即決価格", "Price", "Current Price", "現在価格", "Bids")] == ["buyout", "buyout", "fixed", "current", "current", "other"]


NOW, DAY = "2026-01-02 03:04:05", "2026-01-02"


def raw(spark, n=6):
    items = [(f"https://h/{'mercari' if i % 2 else 'rakuma'}/{i}", "iPhone 13 128GB", f"{10_000 + i} YEN", "Good", "箱あり", i) for i in range(n)] + [(" ", "x", "1", None, None, 90), (None, "x", "1", None, None, 91), ("https://h/mercari/0", "again", "20000", None, None, 92), ("https://h/mercari/1", "Phone", "20000", None, None, 93)]
    return spark.createDataFrame(items, "link string, name string, price string, condition string, explanation string, o int")


def test_ingest_twice_inserts_once(spark, tmp_path):
    path, now = str(tmp_path / "lake"), F.lit(NOW).cast("timestamp")
    lake = spark.createDataFrame([], schema.RAW_ITEMS)
    batch = ingest.extract(raw(spark))
    one = ingest.ingest(batch, lake, path, F.lit("mercari"), now, F.col("o"))
    assert (one.code, one.received, one.valid, one.inserted) == ("inserted", 10, 8, 7)
    two = ingest.ingest(batch, spark.read.parquet(path), path, F.lit("mercari"), now, F.col("o"))
    assert (two.code, two.inserted) == ("all_duplicates", 0)
    assert ingest.ingest(batch.drop("link"), lake, path, F.lit("m"), now, F.col("o")).code == "missing_link_column"
    assert ingest.ingest(batch.limit(0), lake, path, F.lit("m"), now, F.col("o")).code == "empty_df"
    assert ingest.ingest(batch.where("o = 90"), lake, path, F.lit("m"), now, F.col("o")).code == "no_valid_links"
    seen = []
    run_new_files(spark, path, spark.read.parquet(path).schema, str(tmp_path / "checkpoint"), lambda df, _: seen.append(df.count()))
    run_new_files(spark, path, spark.read.parquet(path).schema, str(tmp_path / "checkpoint"), lambda df, _: seen.append(df.count()))
    assert sum(seen) == 7


def test_load_is_idempotent(spark):
    now, today = F.lit(NOW).cast("timestamp"), F.lit(DAY).cast("date")
    lake = schema.conform(ingest.new_rows(ingest.extract(raw(spark)), spark.createDataFrame([], "link string"), F.lit("m"), now, F.col("o")), schema.RAW_ITEMS)
    empty = lambda s: spark.createDataFrame([], s)
    t = etl.load(lake, empty(schema.PRODUCTS), empty(schema.LISTINGS), empty(schema.PRICE_HISTORY), now, today)
    assert {r.name for r in t.products.collect()} == {"Apple iPhone 13 128GB"} and t.listings.count() == 6
    day = t.history.first()
    assert (day.listing_count, float(day.min_price), float(day.max_price)) == (6, 10_000 * 175, 10_005 * 175)
    assert {r.status: r["count"] for r in t.raw.groupBy("status").count().collect()} == {"loaded_mysql": 6, "dropped_etl": 1}
    products, listings, history, after = (x.cache() for x in (t.products, t.listings, t.history, t.raw))
    again = etl.load(after, products, listings, history, now, today)
    assert sorted(again.history.collect()) == sorted(history.collect()) and again.listings.count() == 6 and again.products.count() == 1


def test_price_model_and_questions(spark, tmp_path):
    df = spark.range(300).selectExpr("cast(id as string) as key", "'iPhone' as model_line", "cast(id % 4 + 11 as string) as model_number", "'' as variant", "'Good' as condition", "cast(60 + id % 40 as double) as battery_percentage", "cast(20000 + (id % 4) * 10000 + (id % 40) * 50 as double) as price", "'128' as storage")
    model, errors = models.train_price(df, {"iPhone 11": 2019, "iPhone 14": 2022}, "key", trees=10, depth=6)
    assert {r.part: r.r2 > 0.9 for r in errors.collect()} == {"train": True, "test": True}
    model.save(str(tmp_path / "m"))
    back = models.PriceModel.load(spark, str(tmp_path / "m"), model.years)
    row = models.baseline(df.limit(1).select("key", "model_line", "model_number"), {"storage": "128", "battery_percentage": 70.0})
    assert back.predict(row).first().prediction == model.predict(row).first().prediction
    assert len(model.importance()) == 10
    curve = models.depreciation(row, model.features, model.score)
    assert [(r.device_age_years, r.release_year) for r in curve.orderBy("device_age_years").collect()] == [(a, 2026 - a) for a in range(9)]
    assert models.curve_payload(curve, "key").count() == 1
    half = models.by_age(model.features(row), 2.5, 2.5).first()
    assert half.release_year == 2024
    assert {r.scenario for r in models.impact(row, "key", model.predict).collect()} == {"battery_to_100"}
    every = models.impact(row, "key", model.predict, all_=True)
    assert every.count() == 7
    assert [c["scenario"] for c in json.loads(models.impact_payload(every, "key").first().json)] == sorted(name for name, *_ in models.SCENARIOS)
    pair = models.Ensemble(model, back)
    routed = df.limit(4).withColumn("brand", F.when(F.col("key") == "1", "Apple"))
    assert sorted((r.key, r.prediction) for r in pair.predict(routed).collect()) == sorted((r.key, r.prediction) for r in model.predict(df.limit(4)).collect())
    versions = spark.range(1).select(scalars.model_version(F.lit(0.875)).alias("a"), scalars.model_version(F.lit(0.875), "smart_v1.0").alias("b")).first()
    assert tuple(versions) == ("smart_v1_r2_0.875", "smart_v1.0_r2_0.875")


def test_junk_model(spark):
    df = spark.createDataFrame([(f"iPhone {i} 本体" if i % 2 else f"iPhone {i} ケース", None, str(1000 + i), i % 2 == 0) for i in range(60)] + [("x", None, "1", None)], "name string, explanation string, price string, is_junk boolean")
    model = models.train_junk(df, terms=200, trees=3, depth=3)
    out = model.predict(df).where("name like 'iPhone%'").collect()
    assert all(r.is_junk == ("ケース" in r.name) for r in out)
    assert values(spark, lambda c: models.char_ngrams(c, 2, 3), ["ab", None]) == [[" a", "ab", "b ", " ab", "ab "], []]


def test_search_report_and_profile(spark):
    items = spark.createDataFrame([(1, "u1", "s", "Phone A", "good", 10.0, 1750.0, dt.datetime(2024, 1, 1)), (2, "u2", "s", "phone b", None, None, None, dt.datetime(2024, 1, 2)), (3, "u3", "s", "Case", "good", 1.0, 175.0, dt.datetime(2024, 1, 1))], "id bigint, url string, source string, name string, condition string, price_yen double, price_vnd double, created_at timestamp")
    prices = spark.createDataFrame([(1, 12.0, 2100.0, dt.datetime(2024, 2, 1))], "item_id bigint, price_yen double, price_vnd double, record_time timestamp")
    found = search.search(spark, items, prices, "PHONE")
    assert [(r.url, r.price_yen) for r in found.collect()] == [("u1", 12.0), ("u2", None)]
    stats, box = search.report(found)
    assert {(r.level, r.n) for r in stats.collect()} == {("source", 2), ("condition", 1), ("all", 2)} and box.count() == 2
    assert search.payload(found).first().json.startswith("[{")
    assert [(r.value, r.n) for r in statistics.value_counts(items, "condition").collect()] == [("good", 2)]


def test_tables_and_configuration(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿name,price\n\"two\nlines\",\"5,000\"\n".encode())
    df = tables.read_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("two\nlines", "5,000")] and df.columns == ["name", "price"]
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["name", "price"] and [tuple(r) for r in back.collect()] == [("two\nlines", "5,000")]
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "out").glob("part-*.csv"))
    tables.write_csv(df, str(tmp_path / "plain"), mark=False)
    assert all(f.read_bytes().startswith(b"name,") for f in (tmp_path / "plain").glob("part-*.csv"))
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert tables.read_config(str(tmp_path / "none"), str(tmp_path / "c.json")) == {"a": 1} and tables.read_config("none") == {}
    lake = spark.createDataFrame([("extracted_layer2", None, True), ("extracted_layer2", None, None), ("x", False, None), ("x", None, None)], "status string, processed boolean, is_junk boolean")
    assert tables.lake_selection(lake).count() == 2


def test_keywords(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5, "c": 0.0},), ({"b": 1.0},)], "t map<string,double>")
    assert [(r.term, r.score) for r in statistics.top_terms(df, "t", 2).collect()] == [("b", 0.75), ("a", 0.25)]
    assert df.select(statistics.top_keywords(F.col("t"), 5).alias("k")).first().k == ["a", "b"]
