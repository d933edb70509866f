import random
import re

import numpy as np
import pyarrow as pa
import pytest

from remarkt.llm import components
from remarkt.llm.chosen_path import by_group, links_between, near_duplicates, trees_for
from remarkt.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text, size=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, size=3, percent=85):
    sets = [set_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc) if doc is not None else doc
    return sorted(((doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def family(rng, size, n, edits):
    base = prose(rng, n)
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


def rows_of(seed):
    rng = random.Random(seed)
    texts = [t for k in range(40) for t in family(rng, rng.randrange(1, 6), rng.randrange(20, 200), 5)]
    texts += list(family(rng, 150, 120, 4)) + ["The Same text as ever"] * 30 + ["one", "ONE", "one two", None, "", " \n"]
    hot = " ".join(prose(rng, 60))
    texts += [hot + " " + " ".join(prose(rng, 60)) for _ in range(120)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"leaf": 8, "block": 20})])
def test_equals_brute_force(documents, seed, limits):
    rows = [*rows_of(seed), (None, "The same text as ever")]
    got = near_duplicates(documents(rows).withColumnRenamed("source", "kept"), **limits).collect()
    assert sorted(map(tuple, got), key=str) == [(d, n, c, True if d is None else k) for d, n, c, k in brute(rows)]


def test_real_sample(documents, sample):
    got = near_duplicates(documents(sample)).collect()
    assert sorted(map(tuple, got), key=str) == brute(sample)


def test_repeated_ids_and_empty_table(documents):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24"
    docs = documents([(5, a), (5, a), (5, b), (3, b + " 25"), (9, a + " 26")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("seed", range(10))
def test_by_group_keeps_groups_whole(seed):
    rng = random.Random(seed)
    keys = sorted(rng.randrange(12) for _ in range(rng.randrange(1, 60)))
    batches, lo = [], 0
    while lo < len(keys):
        n = rng.randrange(0, 7)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + n], pa.int64())], names=["k"]))
        lo += n
    seen = [b.column(0).to_pylist() for b in by_group(iter(batches))]
    assert [k for b in seen for k in b] == keys
    assert all(not set(a) & set(b) for i, a in enumerate(seen) for b in seen[:i])


def test_links_connect_what_all_links_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(200) > 0.04], rng.integers(0, 1 << 60, 6).astype(np.uint64)))) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64))]

    def parts(links):
        label = list(range(len(sets)))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == v) for v in label}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert parts(links_between(sets, 85)) == parts(every)


def linked_pairs(rows, got):
    root = {r.doc_id: r.component_id for r in got}
    return sum(root[i] == root[j] for i, j in rows)


@pytest.mark.parametrize(("trees", "least"), [(1, 0.9), (None, 1.0)])
def test_recall_of_branching_at_the_threshold(documents, trees, least):
    rng = random.Random(9)
    common = prose(rng, 60)
    texts, pairs = [], []
    while len(pairs) < 1000:
        # a passage that all share makes nodes large, so that they branch, and unlike documents stay unlike
        own = prose(rng, 90)
        other = list(own)
        for _ in range(rng.randrange(1, 6)):
            other[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        a, b = " ".join(common + own), " ".join(common + other)
        x, y = set_of(a), set_of(b)
        if 85 * len(x | y) <= 100 * len(x & y) < 90 * len(x | y):
            pairs.append((len(texts), len(texts) + 1))
            texts += [a, b]
    got = near_duplicates(documents(texts).repartition(4), trees=trees, leaf=4).collect()
    assert linked_pairs(pairs, got) >= least * len(pairs)
    assert sum(r.kept for r in got) >= len(pairs)


def test_large_groups_meet_leaders_not_each_other(documents):
    rng = random.Random(3)
    base = prose(rng, 100)
    texts = []
    for k in range(600):
        own = list(base)
        own[rng.randrange(100)] = f"y{k}"
        texts.append(" ".join(own))
    # a chain whose links are between neighbours alone
    chain = list(base)
    for k in range(40):
        chain[2 * k] = f"z{k}"
        chain[2 * k + 1] = f"q{k}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    got = near_duplicates(documents(rows).repartition(3), leaf=16, block=50).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_trees_for_a_similarity():
    assert trees_for(85, 2) == 4 and trees_for(80, 2) == 5 and trees_for(100, 2) == 1


def test_five_words_at_four_fifths(documents):
    rng = random.Random(7)
    a = prose(rng, 100)
    texts = [" ".join(a), " ".join(a + prose(rng, 22)), " ".join(prose(rng, 90)), " ".join(a[:60] + prose(rng, 60))]
    got = near_duplicates(documents(texts), shingle=5, percent=80).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(got)] == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_very_long_texts(documents):
    rng = random.Random(8)
    a = prose(rng, 60000)
    b = list(a)
    b[100:200] = prose(rng, 100)
    got = near_duplicates(documents([" ".join(a), " ".join(b), " ".join(prose(rng, 50000)), None])).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(got)] == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_LINKS", 20)
    rng = random.Random(5)
    pairs = [(7, i) for i in range(100, 400)] + [(i, 500) for i in range(380, 420)] + [(3, 600), (500, 501)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(70)]
    label = {x: x for e in pairs for x in e}
    for a, b in pairs * len(label):
        if label[a] != label[b]:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}
