import random
import re
import time

import pytest

from remarkt.llm.licenses import PHRASES, TEMPLATES, Automaton, Scanner, bodies, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    own, places, labels = words_of(text), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        found = [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(documents, sample):
    rows = [*sample, (-1, None), (-2, ""), (-3, "UNDER the MIT-license. Under the MIT License; cc by nc by nc"), (None, "apache license version 2.0"), (-4, "cc by-nc " * 50000)]
    got = sorted(map(tuple, license_scan(documents(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=str)


def test_templates_are_found(documents):
    texts = ["some words " + t + " and more" for _, t in TEMPLATES] + ["the rights of the public are reserved by version 3"]
    got = {r.doc_id: r for r in license_scan(documents(texts)).collect()}
    for i, (label, template) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score >= 0.8
        assert any((s.label, s.first, s.last) == (label, 2, 1 + len(words_of(template))) for s in got[i].spans)
    assert got[len(TEMPLATES)].labels == "" and got[len(TEMPLATES)].score == 0


def test_edited_template_is_chained(documents):
    words = TEMPLATES[4][1].split()
    words[12] = "perhaps"
    words.insert(25, "gladly")
    # a run that repeats the template's beginning does not end the chain
    stray = [*words[:30], *words[:5], *words[30:]]
    got = license_scan(documents([" ".join(words), " ".join(words[:12]), " ".join(stray)])).collect()
    assert [r.labels for r in sorted(got)] == ["bsd-3-clause", "", "bsd-3-clause"]
    assert all(s.cover <= 1 for r in got for s in r.spans)


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(4)]
    text = [rng.randrange(5) for _ in range(60)]
    automaton = Automaton(templates)
    for i, (state, length) in enumerate(automaton.statistics(text)):
        best = max(n for n in range(i + 2) if any(t[k : k + n] == text[i + 1 - n : i + 1] for t in templates for k in range(len(t) - n + 1)))
        assert length == best
        if best:
            assert set(automaton.places[state]) == {(t, k + best - 1) for t, own in enumerate(templates) for k in range(len(own) - best + 1) if own[k : k + best] == text[i + 1 - best : i + 1]}


def test_empty_table_and_clashing_columns(documents):
    df = documents(["a b"]).withColumnRenamed("source", "labels")
    assert license_scan(df).count() == 1 and license_scan(df.limit(0)).count() == 0


def test_full_licences_are_found(documents):
    texts = ["a file of ours " + t + " and code" for _, t in bodies()] + [" ".join(words_of(bodies()[-1][1])[500:560])]
    got = {r.doc_id: r for r in license_scan(documents(texts)).collect()}
    assert {label for label, _ in bodies()} == {"apache-2", "bsd-3-clause", "cc0", "gpl-2", "gpl-3", "lgpl-3", "mit", "mpl-2"}
    for i, (label, text) in enumerate(bodies()):
        assert any((s.label, s.first, s.last) == (label, 4, 3 + len(words_of(text))) and s.cover == 1 for s in got[i].spans), label
    assert got[len(bodies())].labels == ""


@pytest.mark.parametrize("seed", range(30))
def test_chains_equal_brute_force(seed):
    rng = random.Random(seed)
    words = "abcdefgh"
    template = [rng.choice(words) for _ in range(12)]
    scanner = Scanner([("x", " ".join(template))], (), 2, 0.5, 3)
    text = []
    while len(text) < 30:
        at = rng.randrange(12)
        text += template[at : at + rng.randrange(1, 8)] + [rng.choice(words + "z") for _ in range(rng.randrange(3))]
    number = {w: i for i, w in enumerate(sorted(set(template)))}
    runs = scanner.runs([number.get(w, scanner.n) for w in text], 0)
    best = 0

    def grow(covered, last):
        nonlocal best
        best = max(best, covered)
        for _, there, here, length in runs:
            before, at, size = last
            gain = length - max(0, at + size - here, before + size - there)
            if gain > 0 and before < there and at < here and here - at - size <= 3 and here - at <= 3 + 12:
                grow(covered + gain, (there, here, length))

    for _, there, here, length in runs:
        grow(length, (there, here, length))
    found = scanner.chains(runs)
    assert bool(found) == (best >= 0.5 * 12)
    assert not found or max(f[3] for f in found) == min(1.0, best / 12)


def plain_chains(scanner, runs):
    """Chains by trying every predecessor of a run."""
    found = []
    for template in sorted({r[0] for r in runs}):
        own, size = sorted((r[1:] for r in runs if r[0] == template), key=lambda r: (r[1], r[0])), len(scanner.templates[template])
        best = []
        for i, (there, here, length) in enumerate(own):
            ways = [(length, -i)]
            for (before, at, words), (covered, root) in zip(own, best, strict=False):
                gain = length - max(0, at + words - here, before + words - there)
                if gain > 0 and before < there and at < here and here - at - words <= scanner.gap:
                    ways.append((covered + gain, root))
            best.append(max(ways))
        for root in sorted({-r for _, r in best}):
            covered, last = max((c, -i) for i, (c, r) in enumerate(best) if r == -root)
            if covered >= scanner.cover * size:
                found.append((scanner.labels[template], own[root][1], sum(own[-last][1:]) - 1, min(1.0, covered / size)))
    return found


@pytest.mark.parametrize("seed", range(200))
def test_chains_equal_trying_every_predecessor(seed):
    rng = random.Random(seed)
    words = "abcdefgh"[: rng.choice((2, 3, 4, 8))]
    templates = [("x", " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for _ in range(3)]
    scanner = Scanner(templates, (), rng.randrange(1, 4), rng.choice((0.2, 0.5, 0.8)), rng.randrange(6))
    text = []
    while len(text) < 100:
        own = rng.choice(templates)[1].split()
        at = rng.randrange(len(own))
        text += own[at : at + rng.randrange(1, 12)] + [rng.choice(words + "z") for _ in range(rng.randrange(4))]
    number = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t.split()}))}
    runs = scanner.runs([number.get(w, scanner.n) for w in text], 0)
    assert scanner.chains(runs) == plain_chains(scanner, runs)


def test_long_text_of_phrases_is_linear():
    """Growth of the time, not seconds: twice the text takes about twice as long."""
    own = words_of(dict(bodies())["gpl-3"])
    rng, text = random.Random(1), []
    for _ in range(20000):
        at = rng.randrange(len(own) - 10)
        text += own[at : at + rng.randrange(4, 9)]
    scanner = Scanner(bodies())
    number = {w: i for i, w in enumerate(sorted({w for _, t in bodies() for w in words_of(t)} | {w for p, _ in PHRASES for w in p.split()}))}
    took = []
    for n in (len(text) // 2, len(text)):
        runs = scanner.runs([number[w] for w in text[:n]], 0)
        began = time.process_time()
        scanner.chains(runs)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.5
