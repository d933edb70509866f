"""Databases through the Derby that Spark ships, and the stream's log against the batch one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from remarkt.sources import jdbc
from remarkt.sources.tables import read_jdbc, write_jdbc
from remarkt.streaming import changes


@pytest.fixture(scope="module")
def url(tmp_path_factory):
    return f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip_with_pushed_filters_and_parts(spark, url):
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5 if i % 5 else None, i % 2 == 0) for i in range(200)], "id long, name string, price double, flag boolean")
    write_jdbc(df, url, "listings", createTableColumnTypes="name VARCHAR(40)")
    found = jdbc.read_parts(spark, url, "listings", "id", 4)
    assert found.rdd.getNumPartitions() == 4 and rows_of(found) == rows_of(df)
    some = found.where("price > 100 and name = 'n111'").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(price), *IsNotNull(name), *GreaterThan(price,100.0), *EqualTo(name,n111)]" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert rows_of(some) == [(111,)]
    due = read_jdbc(spark, url, '(SELECT "id", "price" FROM listings WHERE "price" IS NULL) due')
    assert rows_of(due) == [(i, None) for i in sorted(range(0, 200, 5), key=lambda i: repr((i, None)))]


def test_a_load_again_appends_nothing(spark, url):
    load = lambda ids: spark.createDataFrame([(f"p{i}", dt.date(2026, 1, 2), float(i)) for i in ids], "product_id string, day date, price double").repartition(3)
    types = "product_id VARCHAR(40)"
    assert jdbc.append_absent(load(range(50)), url, "forecasts", ["product_id", "day"], "first", types) == 50
    assert jdbc.append_absent(load(range(50)), url, "forecasts", ["product_id", "day"], "first", types) == 0
    assert jdbc.append_absent(load(range(40, 70)).unionByName(spark.createDataFrame([(None, None, 1.0)], load([1]).schema)), url, "forecasts", ["product_id", "day"], "second-2", types) == 20
    assert rows_of(read_jdbc(spark, url, "forecasts")) == rows_of(load(range(70)))


def test_a_load_that_died_is_made_good(spark, url):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id long, price double")
    broken = F.udf(lambda x: 1 // (x - 7), "double")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        jdbc.append_absent(df.withColumn("price", broken("id")), url, "history", ["id"], "a")
    assert read_jdbc(spark, url, "history").count() == 0
    # the staging table that it left is replaced
    assert jdbc.append_absent(df, url, "history", ["id"], "a") == 20
    with pytest.raises(Exception, match="history_a|HISTORY_A"):
        jdbc.run(spark, url, "DELETE FROM history", "DROP TABLE history_a")
    assert read_jdbc(spark, url, "history").count() == 20
    assert jdbc.append_absent(df.limit(0), url, "history", ["id"], "none") == 0


@pytest.mark.parametrize("cuts", [0, 1, 4])
def test_stream_log_equals_batch_log(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = [(rng.choice(["a", "b", "c", None, "d"]), dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i // 3), i, rng.choice([None, 1.0, 1.0, 2.0, 3.5])) for i in range(120)]
    schema = "key string, at timestamp, nth long, price double"
    bounds = [0, *sorted(rng.sample(range(1, 120), cuts)), 120]
    out, check, source = (f"file://{tmp_path}/{x}" for x in ("log", "checkpoint", "in"))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        # a run for each part: the state outlives the query
        part = rows[lo:hi]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(source)
        changes.run_change_log(spark.readStream.schema(schema).parquet(source), out, check)
    want = rows_of(changes.batch_log(spark.createDataFrame(rows, schema)))
    assert want and rows_of(spark.read.parquet(out)) == want
    changes.run_change_log(spark.readStream.schema(schema).parquet(source), out, check)
    assert rows_of(spark.read.parquet(out)) == want
