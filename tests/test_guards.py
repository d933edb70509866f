"""Patterns run only where words stand that their matches hold, and nothing is lost by it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from remarkt import config, queries
from remarkt.functions import extract, legacy

PATTERNS = [*config.OLD_FLAGS.values(), *(p for own in config.OLD_FIRST.values() for p, _ in own), *(p for _, p in config.OLD_LINES), *(p for _, p in config.OLD_VARIANTS), *(p for _, p in config.RESTRICTIONS), "SIM.*フリー|シムフリー|sim.*free|SIMロック.*解除"]


@pytest.mark.parametrize(("pattern", "words"), [("ab?c{2}d|x[|\\]]yz", {"d", "yz"}), (r"\bPro\b|プロ", {"pro", "プロ"}), ("(a|b)c*", set()), ("a|", set()), ("(?iu)元箱|箱.*付", {"箱"} | {"付"}), (r"Redmi\s*(Note|\d+)", {"redmi"})])
def test_words_that_a_match_holds(pattern, words):
    found = set(extract.needs(pattern))
    assert found == words or (pattern.startswith("(?iu)元箱") and found in ({"箱"}, {"元箱", "箱"}, {"元箱", "付"}))


def test_guards_lose_no_match(spark):
    rng = random.Random(7)
    pieces = sorted({x for p in PATTERNS for x in re.split(r"[^\w・•○△×]+", re.sub(r"\\.|\[[^]]*\]", "|", p)) if x})
    texts = [None, "", "İPHONE 14", "ıPhone 14", "ﾊﾞｯﾃﾘｰ交換", "ＳＩＭフリー", "SIM\u3000\u2003free", "Face\n\nID OK"]
    for _ in range(400):
        own = [rng.choice(pieces) for _ in range(rng.randrange(1, 5))]
        texts.append(rng.choice(("", " ", "、", "5")).join(rng.choice((x, x.upper(), x.lower(), x.title(), x.replace("i", "ı"))) for x in own))
    df = spark.createDataFrame([(t,) for t in texts], "raw string").select(extract.clean_description(F.col("raw")).alias("t"), extract.folded(F.coalesce("raw", F.lit(""))).alias("low"))
    t, low = F.col("t"), F.col("low")
    rows = df.select(F.array(*(t.rlike(legacy.ANY + p) for p in PATTERNS)).alias("plain"), F.array(*(extract.fits(t, low, legacy.ANY + p) for p in PATTERNS)).alias("guarded")).collect()
    assert all(r.plain == r.guarded for r in rows)
    assert sum(any(r.plain) for r in rows) > 200


def test_no_pattern_runs_unguarded(spark):
    """Of the flags and first patterns, each stands behind a word."""
    plan = queries.QUERIES["old_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    for name in config.OLD_FLAGS:
        made = re.search(rf"[\[,] \(?([^\n]*?) AS {name}#", plan).group(1)
        assert "Contains(" in made
