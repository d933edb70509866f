import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from remarkt.llm import nnls_packing
from remarkt.llm.nnls_packing import combinations, default_tokenizer, nnls, pack, packing_report, places, plan, word_ids

SF = "/root/testdata/sf0.001"


def encode(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, got, window=4096):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    for doc, text in rows:
        ids, at = np.array(encode(text), "<u4"), 0
        for r in sorted(docs.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not docs
    return sum(r.length for r in got) / (window * len(sequences))


def test_round_trip(spark, documents, sample):
    rows = [*sample, (-1, None), (-2, ""), (-3, "It's <|endoftext|> 's 12 \x1c\x1f İSTANBUL ΣΑΣ　é é !!?? don't"), (-4, "word " * 30000), (-5, "q" * 9000)]
    got = packing_report(documents(rows).withColumnRenamed("source", "start").repartition(3)).collect()
    assert check(rows, got) > 0.9
    assert sorted({r.sequence_id for r in got}) == list(range(len({r.sequence_id for r in got})))


def test_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing_report(docs).collect()
    sequences = {r.sequence_id for r in got}
    assert sum(r.length for r in got) / (4096 * len(sequences)) > 0.98
    assert sum(r.length for r in got if r.planned) > 0.4 * sum(r.length for r in got)


def test_repeated_rows_and_empty_table(documents):
    docs = documents([(1, "a b c")] * 7 + [(None, "d")])
    assert Counter(r.doc_id for r in pack(docs).collect()) == {1: 7, None: 1}
    assert pack(docs.limit(0)).count() == 0


def test_words_encode_as_texts():
    text = "Ünï cödé don't stop'll 3.14 ### a\x1cb \x85 x y 漢字かな é́ ́ ﬁ ΩΩ İ"
    assert ids_of([text]) == [encode(text)[:-1]]


def ids_of(texts, **options):
    return [np.frombuffer(b, "<u4").tolist() for b in word_ids(default_tokenizer(), **options).encode(texts)]


def test_signs_after_letters_that_gain_a_mark():
    """Small forms and normal forms can end in a mark, which signs join."""
    texts = ["İ, İ. aİ!!", "क़, क़ DON'T's ÄÖ-- Ж... ΑΣ, Kk, ªº; ŉ: ǅ!", "a\u0301, E\u0331. h\u0331, H\u0331!"]
    assert ids_of(texts) == [encode(t)[:-1] for t in texts]


def test_markers_have_their_own_ids():
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |> <|endoftext|>| x", "<|endoftext|>"]
    assert ids_of(texts) == [encode(t)[:-1] for t in texts]
    assert ids_of(texts)[0] == [3306, 49407, 1002]
    assert 49407 not in ids_of(texts, markers=False)[0]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(nnls_packing, "MEMO", 400)
    ids = nnls_packing.WordIds(default_tokenizer())
    texts = [f"shared <|endoftext|> words {' '.join(f'w{i}x{k}' for k in range(60))}" for i in range(50)]
    got = [np.frombuffer(b, "<u4").tolist() for t in texts for b in ids.encode([t])]
    assert got == [encode(t)[:-1] for t in texts] and len(ids.held) < 700
    ids.forget()
    assert len(ids.held) < 100


@pytest.mark.parametrize("seed", range(6))
def test_places_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    window = 256
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, window + 1), 60, replace=False), rng.integers(1, 3 if seed % 2 else 5000, 60), strict=True)}
    found, planned = places(histogram, window, 8, 4)
    ranks, sequences = defaultdict(list), defaultdict(list)
    for length, lo, hi, at, per, offset in zip(*vars(found).values(), strict=True):
        for r in range(lo, hi):
            ranks[length].append(r)
            sequences[at + (r - lo) // per].append((offset + (r - lo) % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences))) and planned <= len(sequences)
    # greedy: no two sequences could be one, but for what the plan has left
    least = -(-sum(k * v for k, v in histogram.items()) // window)
    assert len(sequences) <= 1.23 * least + 1

@pytest.mark.parametrize("seed", range(8))
def test_nnls_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((6, 15)), rng.normal(1, 2, 6)
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-5).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-5


def test_plan_uses_no_piece_twice():
    rng = np.random.default_rng(5)
    histogram = {k: int(rng.integers(0, 400)) for k in range(1, 33)}
    chosen = plan(histogram, 32)
    used = Counter()
    for kinds, times in chosen:
        assert sum(kinds) == 32
        for k in kinds:
            used[k] += times
    assert all(used[k] <= histogram[k] for k in used)
    assert len(set(combinations(32, 4))) == len(combinations(32, 4)) == 1 + 16 + 85 + 249
