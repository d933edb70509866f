import hashlib
import random
import re

import pyarrow as pa
import pytest

from remarkt.llm import suffix_leaks
from remarkt.llm.suffix_leaks import leak_report, leaks, without_leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    windows = {}
    for item, text in items:
        own = words_of(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for i, text in rows:
        own, hit, names = words_of(text), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if found := windows.get(tuple(own[k : k + size])):
                    hit |= set(range(k, k + size))
                    names |= found
        yield i, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("block", [1 << 24, 700])
def test_equals_brute_force(spark, documents, sample, block):
    import duckdb

    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    items += [(900, "Is"), (901, "the THE"), (902, None), (903, " .. "), (904, items[0][1]), (905, sample[3][1])]
    rows = [*sample, (-1, None), (-2, ""), (-3, items[1][1].upper() + " " + items[2][1]), (-4, "the the the"), (None, items[3][1]), (-5, "é" + items[5][1]), (-5, "é" + items[5][1])]
    docs, benchmark = documents(rows), items_of(spark, items)
    if block > 1000:
        got = leak_report(docs, benchmark).collect()
    else:
        got = leaks(docs, benchmark, block_bytes=block).selectExpr("row.doc_id", "n_words", "n_hit", "cast(size(items) as bigint)", "sha2(array_join(items, ','), 256)", "n_hit > 0", "longest_match", "longest_at", "longest_item", "longest_item_at").collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(brute(rows, items), key=str)
    assert sorted(((r[0], *tuple(r)[6:]) for r in got), key=str) == sorted(longest(rows, items), key=str)


def longest(rows, items, window=10):
    own = sorted((str(i), words_of(t)) for i, t in items if i is not None and words_of(t))
    for doc, text in rows:
        words, best = words_of(text), (0, None, None, None)
        for item, there in own:
            size = min(window, len(there))
            for j in range(len(there)):
                for k in (k for k in range(len(words)) if words[k] == there[j]):
                    n = 0
                    while k + n < len(words) and j + n < len(there) and words[k + n] == there[j + n]:
                        n += 1
                    if n >= size and (n < window) <= (n == len(there)):
                        best = min(best, (-n, k, item, j), key=lambda x: tuple((y is None, y or 0) if not isinstance(y, str) else (False, y) for y in x))
        yield (doc, -best[0], best[1] or 0, *best[2:])


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_longest_match_where_items_share_passages(spark, documents, block):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    a = [word() for _ in range(12)]
    b = [word() for _ in range(12)] + a + [word() for _ in range(12)]
    c = ["the"] * 40
    short = [word() for _ in range(4)]
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(short)), (5, " ".join(b[5:30])), (10, " ".join(b[:20]))]
    texts = [" ".join(b), " ".join(b[3:30] + a + short), " ".join(short + ["x"]), "the " * 25, " ".join(a + b[:22] + ["y"] + b[10:]), " ".join(b[:20] + c), None, " ".join(b[20:] + b[:15])]
    for _ in range(20):
        own = []
        while len(own) < 80:
            own += rng.choice([a, b, c, short, [word()]])[rng.randrange(12) : rng.randrange(5, 40)]
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = leaks(documents(rows).repartition(3), items_of(spark, items), block_bytes=block).selectExpr("row.doc_id", "longest_match", "longest_at", "longest_item", "longest_item_at").collect()
    assert sorted(map(tuple, got)) == sorted(longest(rows, items))
    assert sorted(got)[0].longest_match == 36


def test_a_hash_alone_is_no_match(monkeypatch):
    tests = suffix_leaks.test_suffixes([("1", "a b c d e f g h i j k")], 10)
    tests.raw = tests.raw.replace(b"e", b"x")
    found = suffix_leaks.leaks_of(pa.array(["a b c d e f g h i j k"]), tests)
    assert found["longest_match"].to_pylist() == [0] and found["items"].to_pylist() == [[]]


def test_very_long_text(spark, documents):
    item = [f"i{k}" for k in range(3000)]
    text = " ".join([f"x{k}" for k in range(60000)] + item[100:2900] + ["end"] * 50000)
    got = leaks(documents([text]), items_of(spark, [(1, " ".join(item))])).collect()[0]
    assert (got.n_hit, got.longest_match, got.longest_at, got.longest_item, got.longest_item_at) == (2800, 2800, 60000, "1", 100)

def test_longest_match_and_removal(spark, documents):
    item = " ".join(f"w{i}" for i in range(40))
    docs = documents(["x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z", "w0 w1 w2", None])
    got = {r.row.doc_id: (r.n_hit, r.longest_match, r.longest_at, r.items) for r in leaks(docs, items_of(spark, [(7, item)])).collect()}
    assert got == {0: (25, 25, 2, ["7"]), 1: (0, 0, 0, []), 2: (0, 0, 0, [])}
    kept = without_leaks(docs.withColumnRenamed("source", "n_hit").withColumnRenamed("lang", "odd name"), items_of(spark, [(7, item)]))
    assert kept.columns == ["doc_id", "text", "odd name", "n_hit", "n_chars"] and {r.doc_id for r in kept.collect()} == {1, 2}


def test_empty_tables(spark, documents):
    assert leak_report(documents(["a b"]).limit(0), items_of(spark, [(1, "a")])).count() == 0
    assert [r.n_hit for r in leak_report(documents(["a b"]), items_of(spark, [])).collect()] == [0]


def test_many_matches_are_confirmed_at_once():
    """A text that repeats a window 40,000 times is confirmed in well under its share of seconds; unlike bytes of equal hashes are told apart."""
    import time

    import numpy as np
    import pyarrow as pa

    from remarkt.llm.suffix_leaks import confirmed, test_suffixes
    from remarkt.llm.words import ALNUM, LOWER, Texts

    tests = test_suffixes([("1", "one two three four five six seven eight nine ten eleven")], 10)
    words = Texts(pa.array(["One two three four five six seven eight nine ten " * 40_000 + "one two three four five six seven eight nine tex"])).words(ALNUM, LOWER)
    place = np.arange(0, words.n, 10)
    began = time.process_time()
    for most in (1 << 20, 1):
        some = place if most > 1 else place[-50:]
        assert confirmed(words, some, np.zeros(len(some), np.int64), tests, most).tolist() == [True] * (len(some) - 1) + [False]
    assert time.process_time() - began < 2
