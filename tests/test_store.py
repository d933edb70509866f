"""Bucket tables, layouts, ranks and the trigram index."""

import random
import statistics as pystat
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from remarkt.operators import ranks
from remarkt.plans.trigrams import TrigramIndex, grams, literal_runs
from remarkt.sources.store import BucketTable, write_layout


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.fixture
def table(spark, tmp_path):
    held = BucketTable(spark, f"file://{tmp_path}/t", "link", 16)
    held.create(spark.createDataFrame([(f"k{i}", i, "old") for i in range(400)], "link string, price int, state string"))
    return held


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_load_rewrites_its_buckets_only(spark, table, tmp_path):
    new = spark.createDataFrame([(f"k{i}", 1000 + i, "new") for i in (3, 7, 500)], "link string, price int, state string")
    touched = table.upsert(new, "one", ["price"])
    assert 1 <= len(touched) <= 3
    written = {p.name for p in (tmp_path / "t/data/one").iterdir() if p.is_dir()}
    assert written == {f"_bucket={b}" for b in touched}
    want = {f"k{i}": (f"k{i}", i, "old") for i in range(400)} | {"k3": ("k3", 1003, "old"), "k7": ("k7", 1007, "old"), "k500": ("k500", 1500, "new")}
    assert rows_of(table.read()) == sorted(want.values(), key=repr)


def test_a_load_again_changes_nothing(spark, table):
    new = spark.createDataFrame([("k1", 5, "new")], "link string, price int, state string")
    assert table.upsert(new, "one", ["price"]) and table.upsert(new.withColumn("price", F.lit(6)), "one", ["price"]) == []
    assert table.read().where("link = 'k1'").first().price == 5
    with pytest.raises(ValueError):
        table.create(new, "first")


def test_a_load_that_dies_leaves_the_table_as_it_was(spark, table, tmp_path):
    before = rows_of(table.read())
    new = spark.createDataFrame([(f"k{i}", -1, "new") for i in range(40)], "link string, price int, state string")
    broken = F.udf(lambda x: 1 // 0, "int")

    def fails(old, n):
        return old.unionByName(n).withColumn("price", F.when(F.col("price") < 0, broken("price")).otherwise(F.col("price")))

    with pytest.raises(Exception, match="ZeroDivisionError"):
        table.merge(new, "two", fails)
    assert rows_of(table.read()) == before
    # some of its buckets and a manifest without its mark are there
    table.merge(new, "three", lambda old, n: old)
    last = sorted((tmp_path / "t/manifest").iterdir())[-1]
    (last / "_SUCCESS").unlink()
    (last / "._SUCCESS.crc").unlink()
    assert rows_of(table.read()) == before
    table.upsert(new, "three", ["price"])
    assert rows_of(table.read()) == sorted([(f"k{i}", -1 if i < 40 else i, "old") for i in range(400)], key=repr)


def test_null_keys_empty_loads_and_vacuum(spark, tmp_path):
    schema = "link string, price int"
    held = BucketTable(spark, f"file://{tmp_path}/n", "link", 4)
    with pytest.raises(ValueError):
        held.read()
    held.create(spark.createDataFrame([], schema))
    assert held.read().collect() == []
    assert held.upsert(spark.createDataFrame([], schema), "none", ["price"]) == []
    held.insert_absent(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], schema), "one", ["price"])
    assert rows_of(held.read()) == [("a", 1), ("b", 3)]
    held.merge(spark.createDataFrame([("a", 0)], schema), "gone", lambda old, n: old.join(n, "link", "left_anti"))
    assert rows_of(held.read()) == [("b", 3)]
    held.vacuum()
    assert rows_of(held.read()) == [("b", 3)]
    assert sum(p.name.startswith("_bucket=") for p in Path(f"{tmp_path}/n/data").glob("*/*")) == 1


def test_joins_of_layouts_shuffle_the_new_rows_alone(spark, tmp_path):
    lake = write_layout(spark.range(5000).selectExpr("concat('u', id) as link", "id as price"), "layout_lake", "link", 8, f"file://{tmp_path}/a", ["link"])
    known = write_layout(spark.range(0, 9000, 3).selectExpr("concat('u', id) as link"), "layout_known", "link", 8, f"file://{tmp_path}/b", ["link"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for how in ("left_anti", "left_semi"):
            both = lake.join(known, "link", how)
            assert "Exchange" not in final_plan(both)
        assert lake.join(known, "link", "left_anti").count() == 5000 - 1667
        batch = spark.range(100).selectExpr("concat('u', id * 7) as link").repartition(3)
        assert final_plan(batch.join(lake, "link", "left_anti")).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = spark.table("layout_lake").where("link = 'u77'")
    assert found.count() == 1 and "EqualTo(link,u77)" in plan_of(found)
    one, jvm = next(Path(f"{tmp_path}/a").glob("*.parquet")), spark.sparkContext._jvm
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(one)), spark.sparkContext._jsc.hadoopConfiguration())
    column = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file).getFooter().getBlocks().get(0).getColumns().get(0)
    assert column.getPath().toDotString() == "link" and column.getBloomFilterOffset() > 0


def exact(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    lo, hi = int(at), min(int(at) + 1, len(values) - 1)
    return values[lo] + (at - lo) * (values[hi] - values[lo])


@pytest.mark.parametrize("ranges", [1, 2, 7, 256])
def test_quantiles_and_modes(spark, ranges):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 18 + ["a", None]), rng.choice([None, -1.5, 0.0, 7.0] + [rng.random() * 100 for _ in range(6)]), rng.choice(["x", "y", None])) for _ in range(3000)] + [("none", None, None), ("one", 4.0, "z")]
    df = spark.createDataFrame(data, "k string, v double, m string")
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", {"low": 0.0, "q1": 0.25, "q2": 0.5, "p95": 0.95, "high": 1.0}, ranges).collect()}
    groups = {k: [v for kk, v, _ in data if kk == k and v is not None] for k in {k for k, _, _ in data}}
    assert set(got) == {k for k, v in groups.items() if v}
    for k, r in got.items():
        assert list(r)[1:] == pytest.approx([exact(groups[k], s) for s in (0, 0.25, 0.5, 0.95, 1)])
        assert r.q2 == pytest.approx(pystat.median(groups[k]))
    for r in ranks.modes(df, ["k"], ["v", "m"]).collect():
        for c, i in (("v", 1), ("m", 2)):
            counts = Counter(d[i] for d in data if d[0] == r.k and d[i] is not None)
            assert r[c] == (min(v for v, n in counts.items() if n == max(counts.values())) if counts else None)
    assert ranks.quantiles(df.where("false"), ["k"], "v", {"q": 0.5}).collect() == ranks.modes(df.where("false"), ["k"], ["v"]).collect() == []


def test_a_hot_key_is_spread(spark):
    """Of a key with nine rows in ten and as many values, no window group holds more than a few hundredths."""
    df = spark.range(20000).selectExpr("if(id % 10 < 9, 0, id) as k", "cast(pmod(xxhash64(id), 1000003) as double) as v")
    bounds = ranks.splitters(df, "v", 64)
    largest = df.groupBy("k", ranks.range_of(F.col("v"), bounds).alias("r")).count().agg(F.max("count")).first()[0]
    assert len(bounds) == 63 and largest < 20000 * 0.05
    assert "percentile" not in plan_of(ranks.quantiles(df, ["k"], "v", {"q": 0.5}, 64))


def test_trigrams(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, "".join(rng.choices(["ab", "B", "c%", "_d", "é", "日本", "İ", " ", "\\", "'"], k=rng.randint(0, 12)))) for i in range(400)] + [(1000, None), (1001, ""), (1, "ABCABC")]
    df = spark.createDataFrame(items, "id int, name string").withColumn("_gram", F.lit(1))
    index = TrigramIndex(spark, f"file://{tmp_path}/i", parts=8).build(df)
    for keyword in ("abc", "ABC", "bc\\%", "b_c", "abb%b", "%", "", "é日本", "a", "c\\%\\_d", "nothing", "'", "_d\\\\", "bab"):
        says = "'" + keyword.replace("\\", "\\\\").replace("'", "\\'") + "'"
        want = df.where(f"name ilike concat('%', {says}, '%')")
        assert rows_of(index.search(keyword)) == rows_of(want), keyword
    plan = plan_of(index.search("abbab"))
    assert "PushedFilters: [In(_gram" in plan and "PartitionFilters: [_part" in plan


def test_grams_and_runs(spark):
    assert literal_runs("a%b_c\\%d\\\\") == ["a", "b", "c%d\\"] and literal_runs("%_") == []
    assert spark.range(1).select(grams(F.lit("AbAbA"))).first()[0] == ["aba", "bab"]


def test_a_folder_of_its_own_where_none_is_named(spark):
    from types import SimpleNamespace

    from remarkt.sources.store import shared_dir

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a1"))
    assert shared_dir(unset("local[2]")) == shared_dir(unset("local[2]")) != shared_dir(spark)
    with pytest.raises(ValueError, match="unset"):
        shared_dir(unset("spark://x"))
