import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from remarkt.llm.histogram_sort import find_splitters, shard_by_bytes, shard_report


def check(rows, got, shards):
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 8) for i, t in rows if i is not None)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    aim, largest = sum(sizes.values()) / shards, max(r.size for r in got)
    assert all(abs(sizes[s] - aim) <= largest + 0.02 * aim for s in range(shards))


def test_bytes_are_near_equal(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shard_report(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got, 24)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


@pytest.mark.parametrize("many", [3000])
def test_hot_text_is_cut(documents, many):
    rows = [(i, "the same text again and again") for i in range(many)] + [(i, f"other {i} " * (i % 9)) for i in range(many, 2 * many)] + [(9_999_999, None), (None, None), (5, "é" * 900)]
    got = shard_by_bytes(documents(rows), 24, range_bytes=4000).collect()
    check(rows, got, 24)
    assert len({r.shard for r in got if r.text == "the same text again and again"}) > 5


def test_equal_small_groups_stay_together(documents):
    rows = [(i, f"text number {i // 3} with some words in it") for i in range(6000)]
    where = defaultdict(set)
    for r in shard_by_bytes(documents(rows), 8).collect():
        where[r.text].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 7


def test_repeated_rows_empty_table_and_clashing_columns(documents):
    docs = documents([(1, "a")] * 50 + [(2, "b")] * 3)
    got = shard_by_bytes(docs.withColumnRenamed("source", "slot").withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "key"), 4).collect()
    check([(1, "a")] * 50 + [(2, "b")] * 3, got, 4)
    assert shard_by_bytes(docs.limit(0), 4).count() == 0 and shard_report(docs.limit(0)).count() == 0


def test_rows_alike_in_all_columns_are_cut(documents):
    rows = [(7, "always the same row")] * 4000 + [(i, f"another {i}") for i in range(1000)]
    got = shard_by_bytes(documents(rows).repartition(5), 10, range_bytes=4000).collect()
    check(rows, got, 10)
    assert len({r.shard for r in got if r.doc_id == 7}) > 5


def test_splitters_equal_a_full_sort(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1 << 63), rng.randrange(8, 3000)) for _ in range(5000)]
    found = find_splitters(spark.createDataFrame(rows, "key bigint, size bigint"), 6, 0.001, 1 << 30)
    ordered, total, upto = sorted(rows), sum(s for _, s in rows), 0
    first = {}
    for key, size in ordered:
        shard = int(found.shard[max(0, np.searchsorted(found.first, key, "right") - 1)])
        first.setdefault(shard, upto)
        upto += size
    assert sorted(first) == list(range(6))
    assert all(abs(at - k * total / 6) <= 0.001 * total / 6 + 3000 for k, at in first.items())


def test_maps_at_any_depth_and_long_texts(documents):
    docs = documents([(i, "long " * 40000 if i == 3 else f"text {i}") for i in range(40)] + [(None, None)])
    wide = docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("deep", F.array(F.struct(F.create_map(F.lit("b"), F.lit(2)).alias("x")))).withColumnRenamed("lang", "C0")
    got = shard_by_bytes(wide, 3).collect()
    assert len(got) == 41 and all(r.m == {"a": 1} and r.deep[0].x == {"b": 2} for r in got)


def test_each_range_is_a_task_and_rows_move_once(documents):
    docs = documents([(i, f"text number {i} of many") for i in range(3000)])
    found = shard_by_bytes(docs, 4, range_bytes=1000)
    assert found.rdd.glom().map(lambda part: len({r.shard for r in part})).max() == 1
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
