import re

from remarkt.llm.compression import BANDS, CHUNK, CHUNK_LIMITS, CHUNK_SHARE, compression_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_counts_equal_brute_force(documents, sample):
    odd = [(-1, None), (-2, ""), (-3, " \n\t\n "), (-4, "é　ü x\x85y\n\nq\nq\nq"), (-5, "a b c d e " * 300), (None, "one two"), (-6, "ñ" * 70000), (-6, "ñ" * 70000)]
    rows = [*odd, *sample]
    got = sorted(map(tuple, compression_rules(documents(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=str)


def test_verdict(documents, sample):
    import random

    prose = next(t for _, t in sample if len(t) > 3000)
    noise = " ".join("".join(random.Random(7 * i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60)) for i in range(60))
    repeated = " ".join(f"{a} same words {b}" for a in "abcdefg" for b in range(120))
    kept = {r.doc_id: r.kept for r in compression_rules(documents([prose, noise, repeated, None])).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}


def test_empty_table_and_clashing_columns(documents):
    df = documents(["a b"]).withColumnRenamed("n_chars", "kept").withColumnRenamed("source", "n_words")
    assert compression_rules(df).count() == 1
    assert compression_rules(df.limit(0)).count() == 0


def test_tail_counts(documents, sample):
    import random

    prose = next(t for _, t in sample if len(t.encode()) > 6000 and t.isascii())
    noise = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2047))
    got = {r.doc_id: r for r in compression_rules(documents([prose[:2048] + noise, prose[:4095], prose[:4096], prose[:700], noise[:700], ""])).collect()}
    assert [got[i].n_chunks for i in range(6)] == [2, 2, 2, 1, 1, 0]
    assert got[0].n_bad_chunks == 1 and got[0].zstd_ratio < 0.72 and not got[0].in_band
    assert [got[i].n_bad_chunks for i in range(1, 4)] == [0, 0, 0] and got[1].in_band
    assert got[3].in_band == (got[3].n_bad_chunks == 0) and got[4].in_band == (got[4].n_bad_chunks == 0)


def verdict(text):
    import zstandard

    raw = (text or "").encode()
    if not raw:
        return 0, 0, True
    size = lambda part: len(zstandard.ZstdCompressor(level=3).compress(part))
    low, high = [(lo, hi) for at, lo, hi in BANDS if len(raw) >= at][-1]
    inside = low <= size(raw) / len(raw) <= high
    if len(raw) < CHUNK:
        bad = [not inside]
    else:
        parts = [raw[k : k + CHUNK] for k in range(0, len(raw) - CHUNK + 1, CHUNK)]
        parts += [raw[-CHUNK:]] if len(raw) % CHUNK else []
        bad = [not CHUNK_LIMITS[0] <= size(p) / CHUNK <= CHUNK_LIMITS[1] for p in parts]
    return len(bad), sum(bad), inside and sum(bad) <= CHUNK_SHARE * len(bad)


def test_ratios_and_verdict_equal_brute_force(documents, sample):
    rows = [*sample, (-1, None), (-2, ""), (-3, "ab" * 40_000), (-4, "x" * 2048), (-5, "x" * 2049)]
    got = {r.doc_id: (r.n_chunks, r.n_bad_chunks, r.in_band) for r in compression_rules(documents(rows)).collect()}
    assert got == {i: verdict(t) for i, t in rows}
