"""Search against the contract's formula, document by document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from remarkt.llm import ranked_search
from remarkt.llm.ranked_search import Heaps, accumulate, hashed, radix_order, search, terms_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, best=20):
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, all_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        asked[i] = asked.get(i, Counter()) + Counter(words(t))
    out = []
    for i, query in asked.items():
        scores = []
        for d, c in held:
            m = 75 + 25 * c.total() * total // all_terms
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in query.items() if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def corpus():
    rng = random.Random(5)
    vocabulary = [*"abcdefgh", "Word", "word", "WORD", "été", "Été", "日本", "x1", "a_b", "don't", "Z" * 300]
    return [(k * 7 % 101, " ".join(rng.choices(vocabulary, weights=[2 ** (9 - min(j, 9)) for j in range(len(vocabulary))], k=rng.randint(0, 30)))) for k in range(400)], [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for k in range(30)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_brute_force(spark, corpus, block_bytes):
    """Ids that repeat, many ties; one block of items or several; ranges of few documents."""
    docs, items = corpus
    assert got(search(frame(spark, docs, "doc_id").repartition(5), frame(spark, items, "item_id"), block_bytes=block_bytes, triples=100)) == brute(docs, items)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (None, "alpha"), (2, None), (3, ""), (4, "  ... "), (5, "gamma ALPHA")]
    items = [(7, "alpha"), (7, "beta beta"), (None, "gamma"), (None, "alpha"), (8, None), (9, "unknown")]
    d = frame(spark, docs, "doc_id").selectExpr("*", "1 as item_id", "2 as rank", "3 as score", "4 as terms")
    i = frame(spark, items, "item_id").selectExpr("*", "1 as doc_id", "2 as block", "3 as n")
    assert got(search(d, i)) == brute(docs, items)


def test_empty_tables(spark):
    some, none = frame(spark, [(1, "a b")], "doc_id"), frame(spark, [], "doc_id")
    for docs, items in ((none, some), (some, none), (none, none)):
        assert search(docs, items.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_large_group_of_copies_and_a_long_text(spark):
    docs = [(k, "the same words of all copies") for k in range(3000, 0, -1)] + [(0, "the words " * 50_000), (9999, "other things")]
    items = [(1, "same words of copies"), (2, "things other the"), (3, "the " * 5000)]
    assert got(search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))) == brute(docs, items)


def test_terms_of_equal_hashes(monkeypatch):
    """Bytes decide where hashes collide."""
    import pyarrow as pa

    monkeypatch.setattr("remarkt.llm.words.Words.hashes", lambda self: (self.ends - self.starts).astype(np.uint64))
    terms = terms_of(["aa bb cc", "bb d"])
    assert terms.spelt == [b"d", b"aa", b"bb", b"cc"]
    made = ranked_search.postings(pa.array(["cc aa cc x d yy ddd", None, "bb"]), terms)
    assert made["terms"].to_pylist() == [[0, 1, 3], [], [2]] and made["tf"].to_pylist() == [[1, 1, 2], [], [1]] and made["n"].to_pylist() == [7, 0, 1]
    assert hashed(["A b"])[1] == [b"a", b"b"]


def test_radix_order_and_sums():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 40, 5000)
    assert (radix_order(keys, 1 << 40) == np.argsort(keys, kind="stable")).all()
    items, docs, impacts = rng.integers(0, 9, 3000), np.sort(rng.integers(0, 40, 3000)), rng.integers(1, 99, 3000)
    want = Counter()
    for i, d, s in zip(items.tolist(), docs.tolist(), impacts.tolist(), strict=True):
        want[i, d] += s
    assert [(i, d, s) for i, d, s in zip(*(x.tolist() for x in accumulate(items, docs, impacts, 9)), strict=True)] == [(*k, want[k]) for k in sorted(want)]


def test_heaps_keep_the_smallest_ids_of_ties():
    rng = random.Random(1)
    for _ in range(50):
        heaps, all_rows = Heaps(4), []
        for _ in range(6):
            ids = sorted(rng.sample(range(500), 12)) + [None]
            scores = np.array([rng.randint(0, 3) for _ in ids])
            heaps.add(np.zeros(len(ids), np.int64), np.arange(len(ids)), scores, ids)
            all_rows += [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), ids, strict=True) if s > 0]
        want = [(0, None if none else d, -s) for s, none, d in sorted(all_rows)[:4]]
        rows = heaps.rows(0).to_pydict()
        assert sorted(zip(rows["item"], rows["doc_id"], rows["score"], strict=True), key=str) == sorted(want, key=str)


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall(), duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    assert got(search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))) == brute(docs, items)
