"""Sizes in titles and descriptions against a plain reading of them; values that pass through CSV."""

import random
import re

from pyspark.sql import functions as F

from remarkt.functions import extract
from remarkt.sources import tables

UNITS = {"GB": 1, "ギガ": 1, "TB": 1024, "テラ": 1024}


def found(text, units="GB|gb|TB|tb|ギガ|テラ"):
    pairs = [(int(n), u.upper()) for n, u in re.findall(rf"(\d+)\s*({units})", text)]
    return [(n * UNITS[u], f"{n}{'GB' if UNITS[u] == 1 else 'TB'}") for n, u in pairs]


def test_sizes_equal_a_plain_reading(spark):
    rng, texts = random.Random(3), ["", "no size", "GB", "12 GB / 12GB", "1024GB 1TB", "1TB 1024 ギガ", "31GB", "32gb", "2テラ8ギガ", "99999999999999999999GB", "99999999999999999999GB 64GB"]
    for _ in range(300):
        texts.append(" ".join(f"{rng.choice((4, 8, 24, 25, 32, 64, 512, 1024))}{rng.choice(('', ' '))}{rng.choice((*UNITS, 'gb', 'tb', 'Gb', 'MB'))}{rng.choice(('', ' x', '/'))}" for _ in range(rng.randrange(5))))
    t = F.col("text")
    got = spark.createDataFrame([(x,) for x in texts], "text string").select("text", extract.capacity(t).alias("capacity"), extract.ram(t).alias("ram"), extract.description_storage(t).alias("storage")).collect()
    for r in got:
        # a number beyond 64 bits is no size
        own = [(g, x) for g, x in found(r.text) if int(x[:-2]) < 1 << 63]
        small = [(g, x) for g, x in found(r.text, "GB|gb|ギガ") if g <= 24]
        assert r.capacity == max(own, key=lambda p: p[0], default=(0, None))[1], r
        assert r.ram == min(small, key=lambda p: p[0], default=(0, None))[1], r
        assert r.storage == max((p for p in own if p[0] >= 32), key=lambda p: p[0], default=(0, None))[1], r


def test_guards_of_battery_and_memory_lose_nothing(spark):
    texts = [None, "", "バッテリー 91％", "battery: 85 %", "BATTERY 70", "最大容量80%", "RAM 8Gb", "メモリ 12 gB", "16GB メモリ", "RAM 64GB", "RAM 8"]
    t = F.col("text")
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in texts], "text string").select(extract.battery_percentage(t), extract.description_ram(t)).collect()]
    assert got == [(None, None), (None, None), (91, None), (85, None), (None, None), (80, None), (None, "8GB"), (None, "12GB"), (None, "16GB"), (None, None), (None, None)]


def test_csv_keeps_blanks_quotes_and_lines(spark, tmp_path):
    rows = [(1, "  led and trailed  "), (2, 'say "this", then\n"that"\\'), (3, None), (4, "\t"), (5, "a\n\nb"), (6, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), df.schema).collect())) == [*rows[:-1], (6, None)]
