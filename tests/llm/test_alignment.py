"""Alignment against the definition: whole texts encoded, every pair of tokens compared."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from remarkt.llm.alignment import align, alignment_report, default_tokenizers, tokenizers

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  ", "\n", "a", " a ", "a  b", "a \n b", "x  y", "x   y", "x　 　y", "word▁word", "<s> </s> <unk> <0x41>", "<|endoftext|> <|endoftext|>", "don't we'll  it's", "\x00 \x1c a \x85 b", "日本語の文章です。 次の文", "🙂🙂 👩‍👩‍👧 é é", "x" * 3000, "ab " * 2000, "\t\t\tx  y\r\n z", "naïve — “quoted”  text…", "123456 7 89,10", "﻿bom ​ zero", "\x7f a \x7f  b", "İ ı ß ẞ ﬁ"]


def brute(rows):
    a_path, b_path = default_tokenizers()
    both = tokenizers(a_path, b_path)
    made = []
    for doc_id, text in rows:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        for ids, held in ((a, both.bytes_a), (b, both.bytes_b)):
            if text and b"".join(held[i] for i in ids) != (" " + text).encode():
                a = b = []
        spans = []
        for ids, held in ((a, both.bytes_a), (b, both.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(held[i]), i))
                at += len(held[i])
            spans.append(out)
        links, k = [], 0
        for lo, hi, i in spans[0]:
            while k and spans[1][k - 1][1] > lo:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < hi:
                if spans[1][k][1] > lo:
                    links.append((i, spans[1][k][2]))
                k += 1
        shared = sorted({hi for _, hi, _ in spans[0]} & {hi for _, hi, _ in spans[1]})
        groups, before = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for lo, hi, i in side if before < hi <= end) for side in spans) if len(spans[0]) < 500 else None)
            before = end
        written = ";".join(groups) if groups and groups[0] is not None else None
        made.append((doc_id, len(a), len(b), len(shared), links, "" if not a else written and hashlib.sha256(written.encode()).hexdigest()))
    counts = Counter(p for *_, links, _ in made for p in set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(d, na, nb, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest) for d, na, nb, g, links, digest in made]


def check(got, rows):
    got, want = sorted(tuple(r[c] for c in COLUMNS) for r in got), sorted(brute(rows), key=lambda x: x[:7])
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


def fuzzed(n, seed=1):
    rng = random.Random(seed)
    signs = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " ", "　", " ", "é", "ö", "日", "本", "🙂", "'s", "'", "1", "22", ".", ",", "\x1c", "\x85", "\x7f", "<s>", "​", "́", "Ж", " "]
    return ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_brute_force(spark, documents, hot, sample):
    """Odd texts, random ones and some of the table; all pairs sent, some, none."""
    rows = list(enumerate([*ODD, *fuzzed(300), *(t for _, t in sample[:60] if len(t or "") < 4000)]))
    check(alignment_report(documents(rows), hot=hot).collect(), rows)


def test_cuts_never_change_ids():
    """Pieces encoded one by one give the ids of the whole text."""
    import pyarrow as pa

    from remarkt.llm.alignment import cut, upto

    both = tokenizers(*default_tokenizers())
    texts = [t for t in fuzzed(3000, seed=2) if "▁" not in t]
    pieces, first = cut(pa.array(texts))
    a, b = both.encode(pieces.to_pylist())
    for k, t in enumerate(texts):
        own = [side.flat[upto(side.count)[first[k]] : upto(side.count)[first[k + 1]]] for side in (a, b)]
        assert own == [both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)]


def test_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "same text here", 5), (1, "same text here", 5), (None, "other text", 6), (2, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs long").selectExpr("*", "pairs as row", "pairs as n_a", "pairs as times")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in alignment_report(docs).collect()), key=str)
    assert got == sorted(brute([r[:2] for r in rows]), key=str)


def test_empty_table(spark, documents):
    assert alignment_report(documents([]).where("false")).collect() == []
    assert [tuple(r)[1:7] for r in alignment_report(documents(["", None])).collect()] == [(0,) * 6] * 2


def test_lists_and_products(spark, documents):
    row = align(documents(["tokenization of unbelievable words"])).first()
    assert sum(row.times) == row.n_links >= max(row.n_a, row.n_b) and row.n_products >= row.n_links and row.pairs == sorted(set(row.pairs))


def test_paths_are_parameters(spark, documents):
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents(["one text"])
    assert alignment_report(docs, paths).collect() == alignment_report(docs).collect()
