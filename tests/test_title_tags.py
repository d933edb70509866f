"""The trie matcher's walk against its rules, character by character."""

import random

import pytest
from pyspark.sql import functions as F

from remarkt import config
from remarkt.functions.extract import aliases, trie, walked

DICTIONARIES = {"b": config.BRANDS, "v": config.VARIANTS, "c": config.COLORS}


def rules(text, names):
    """The longest word from here that an edge follows; behind that edge it goes on."""
    text, out, at = text.lower(), [], 0
    edge = lambda i: i >= len(text) or not (text[i].isascii() and (text[i].isalnum() or text[i] == "_"))
    while at < len(text):
        fits = [w for w in names if text.startswith(w, at) and edge(at + len(w))]
        if fits:
            word = max(fits, key=len)
            out.append(names[word])
            at += len(word)
        else:
            while not edge(at):
                at += 1
        at += 1
    return out


def titles(n, seed):
    rng = random.Random(seed)
    words = [w for d in DICTIONARIES.values() for own in d.values() for w in own]
    edges = [" ", "", "黒", "/", "_", "い", "  ", "1", "-", "の", "x", "\n", "é", "İ", "🙂", "("]
    return ["".join(rng.choice(words if k % 2 == 0 else edges) if rng.random() < 0.9 else rng.choice(words)[: rng.randint(1, 6)] for k in range(rng.randint(1, 9))) for _ in range(n)]


def test_walk_against_its_rules(spark):
    rows = [(i, t) for i, t in enumerate([*titles(3000, 1), "", "Pro Max", "pro maxi", "黒iPhone", "x黒", "x 黒", "黒黒黒", "iPhone黒", "PRODUCT(RED)", "Product Red)", "Z Fold", "mi", "OP", "motorola", "_Pro", "Pro_", "金金 金"])] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r for r in df.select("id", *(walked(F.col("t"), d).alias(n) for n, d in DICTIONARIES.items())).collect()}
    for i, t in rows:
        for n, d in DICTIONARIES.items():
            assert got[i][n] == (None if t is None else rules(t, aliases(d, True))), (t, n)


@pytest.mark.parametrize("words", [["a"], ["pro", "pro max", "promo"], ["product(red)", "a.b", "a+b", "a"]])
def test_trie_finds_its_words_longest_first(words):
    import re

    pattern = re.compile(trie(words).replace("\\#", "#"))
    for w in words:
        assert pattern.match(w + "!")[0] == max((x for x in words if (w + "!").startswith(x)), key=len)


def test_stays_in_the_jvm(spark):
    plan = spark.range(1).select(walked(F.lit("a"), config.COLORS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
