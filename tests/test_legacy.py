"""The older extractors against their patterns, one text at a time."""

import random
import re

from remarkt import config
from remarkt.functions import legacy
from remarkt.queries import OLD_PHRASES, OLD_TITLES


def fits(pattern, text):
    return re.search(pattern, text, re.IGNORECASE)


def test_descriptions(spark):
    rng = random.Random(2)
    texts = [rng.choice(["、", " ", "。"]).join(rng.choices([*OLD_PHRASES, "・ 箱", "• charger", "no box", "SIM フリー"], k=rng.randint(0, 4))) for _ in range(300)] + [None, "", "RAM 4GB 256GB", "ram 4GB", "RAM 32GB", "8GB RAM 1TB 512GB"]
    got = legacy.description_features(spark.createDataFrame(list(enumerate(texts)), "id int, explanation string")).collect()
    for r in got:
        # folded forms are the same but for signs of full width
        t = (texts[r.id] or "").replace("％", "%")
        for name, pattern in config.OLD_FLAGS.items():
            assert r[name] == bool(fits(pattern, t)), (name, t)
        for name, cases in config.OLD_FIRST.items():
            want = next((v for p, v in cases if fits(p, t)), None)
            assert r[name] == (bool(want) if name in ("has_damage", "has_issues") else want), (name, t)
    last = {r.id - 302: (r.ram, r.storage) for r in got if r.id >= 302}
    assert last == {0: ("4GB", "256GB"), 1: (None, None), 2: (None, "32GB"), 3: ("8GB", "1TB")}


def test_titles(spark):
    rng = random.Random(3)
    titles = [" ".join(rng.choices(OLD_TITLES, k=rng.randint(0, 4))) for _ in range(300)]
    got = legacy.title_features(spark.createDataFrame(list(enumerate(titles)), "id int, name string")).collect()
    for r in got:
        # the cleaning of titles takes kana away, which the same range does there
        t = re.sub("[\u24c2-\U0001f251]+", " ", titles[r.id])
        t = re.sub(r"\\s+", " ", t).strip()
        hits = [(n, m[1].strip()) for n, p in config.OLD_LINES if (m := fits(p, t))]
        assert (r.model_line, r.model_number) == (hits[-1] if hits else (None, None)), t
        assert r.variant == (" ".join(n for n, p in config.OLD_VARIANTS if fits(p, t)) or None)
        assert r.color == next((n for w, n in config.OLD_COLORS if w.lower() in t.lower()), None)


def test_brands_are_tokens(spark):
    rows = ["Appleの箱", "Pineapple", "sony xperia 5", "ソニーズ", "iPhone 8", "【SHARP】 Google", None]
    got = [r.brand for r in legacy.title_features(spark.createDataFrame([(t,) for t in rows], "name string")).collect()]
    assert got == ["Apple", None, "Sony", None, "Apple", "Google", None]
