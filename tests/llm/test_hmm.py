import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from remarkt.llm import hmm
from remarkt.llm.hmm import Model, language_model_report, language_scores, pack_ids, unpack_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(w for (i, t), h in zip(rows, held, strict=True) if i is not None and not h for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    for (i, t), h in zip(rows, held, strict=True):
        own = tokens_of(t)
        yield i, h, len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)


def test_counts_and_base_score_equal_brute_force(documents, sample, monkeypatch):
    rows = [*sample, (-1, None), (-2, ""), (-3, "Never seen wordsx"), (None, "the of"), (-4, "the " * 40000), (-4, "the " * 40000)]
    docs = documents(rows).withColumnRenamed("source", "score").repartition(3)
    got = language_model_report(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_beats_single_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in language_model_report(docs).collect() if r.held_out]
    assert len(rows) > 100
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.05 * sum(r.n_tokens for r in rows)


def paths(model, classes):
    """Likelihood by summing over all state sequences."""
    import itertools

    total = 0.0
    for states in itertools.product(range(len(model.start)), repeat=len(classes)):
        p = model.start[states[0]] * model.emit[states[0], classes[0]]
        for a, b, c in zip(states, states[1:], classes[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, c]
        total += p
    return math.log(total)


def test_forward_is_exact():
    model = Model.random(3, np.array([4.0, 2, 1, 7]))
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 4, n) for n in (1, 2, 5, 6, 6, 3, 7, 4)]
    assert np.allclose(model.likelihood(texts), [paths(model, t) for t in texts])
    long = [rng.integers(0, 4, n) for n in (9000, 50, 40, 30, 20, 10)]
    one = np.log(1.0)
    alpha = model.start.copy()
    for t, c in enumerate(long[0]):
        alpha = (alpha @ model.move if t else alpha) * model.emit[:, c]
        one += np.log(alpha.sum())
        alpha /= alpha.sum()
    assert np.isclose(model.likelihood(long)[0], one)
    # one row of probabilities: all texts of two classes sum to 1
    assert np.isclose(sum(math.exp(x) for x in model.likelihood([np.array([a, b]) for a in range(4) for b in range(4)])), 1)


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_expected_counts_equal_brute_force(monkeypatch, segment):
    import itertools

    monkeypatch.setattr(hmm, "SEGMENT", segment)
    model, states, classes = Model.random(2, np.array([4.0, 2, 1])), 2, 3
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, classes, n) for n in (1, 7, 2, 6, 5, 3)]
    start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)), 0.0
    for t in texts:
        every = {}
        for path in itertools.product(range(states), repeat=len(t)):
            p = model.start[path[0]] * model.emit[path[0], t[0]]
            for a, b, c in zip(path, path[1:], t[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, c]
            every[path] = p
        total = sum(every.values())
        log += math.log(total)
        for path, p in every.items():
            start[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p / total
            for a, c in zip(path, t, strict=True):
                emit[a, c] += p / total
    assert np.allclose(model.expected(texts), [*start, *move.ravel(), *emit.ravel(), log])
    assert np.allclose(model.likelihood(texts), [paths(model, t) for t in texts])


def test_cuts_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 9, n) for n in (5000, 1, 129, 128, 127, 700, 256)]
    model = Model.random(4, np.arange(1.0, 10))
    found, logs = model.expected(texts), model.likelihood(texts)
    apart = sum(model.expected([t]) for t in texts)
    monkeypatch.setattr(hmm, "SEGMENT", 8192)
    assert np.allclose(found, model.expected(texts)) and np.allclose(found, apart) and np.allclose(logs, model.likelihood(texts))


def test_likelihood_depends_on_the_text_alone():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 9, n) for n in (3000, 900, 40, 2000, 7)]
    model = Model.random(4, np.arange(1.0, 10))
    assert np.allclose(model.likelihood(texts), [model.likelihood([t])[0] for t in texts], rtol=1e-12)


def test_only_long_texts(documents):
    rng = np.random.default_rng(9)
    docs = documents([(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 6000))) for i in range(12)])
    rows = language_model_report(docs).collect()
    assert all(math.isfinite(r.score) for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows) - 0.02 * sum(r.n_tokens for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_raise_the_likelihood(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.choice(6, rng.integers(1, 150), p=p) for p in ([0.5, 0.3, 0.1, 0.05, 0.03, 0.02], [0.02, 0.03, 0.05, 0.1, 0.3, 0.5]) for _ in range(20)]
    model, last = Model.random(2, np.bincount(np.concatenate(texts), minlength=6).astype(float), seed), -np.inf
    for _ in range(8):
        sums = model.expected(texts)
        assert np.isclose(sums[2 + 4 : -1].sum(), sum(map(len, texts))) and np.isclose(sums[:2].sum(), len(texts)) and np.isclose(sums[2:6].sum(), sum(len(t) - 1 for t in texts))
        assert sums[-1] >= last - 1e-6
        last, model = sums[-1], Model.of_counts(sums, 2, smooth=1e-9)


def test_packing_of_ids():
    ids = np.array([0, 1, 255, 256, 70000])
    assert unpack_ids(pack_ids(ids, 3), 3).tolist() == ids.tolist()


def test_empty_tables(documents):
    docs = documents(["a b", None]).selectExpr("doc_id", "text", "true as held_out", "false as learn")
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in language_scores(docs).collect()} == {(3, 0, 0), (1, 0, 0)}
    assert language_model_report(documents(["a"]).limit(0)).count() == 0


def test_each_block_has_a_task_of_its_own(spark):
    """Blocks of several input tasks, of unlike numbers, are numbered without gaps."""
    from remarkt.llm import hmm

    blocks = [(task << 24) + k for task, n in ((0, 3), (2, 1), (7, 5)) for k in range(n)]
    coded = spark.createDataFrame([(b, kind, lid) for b in blocks for kind, lid in ((0, 0), (0, 1), (1, None), (1, None))], "block long, kind int, lid int")
    placed, tasks = hmm.by_number(coded, coded)
    rows = placed.repartitionById(tasks, "nth").selectExpr("spark_partition_id() as p", "block", "nth").distinct().collect()
    assert tasks == len(rows) == 9 and {r.block: r.nth for r in rows} == {b: i for i, b in enumerate(blocks)} and len({r.p for r in rows}) == 9
    empty = coded.where("false")
    assert hmm.by_number(empty, empty)[1] == 1
