"""A forest over merged rows against a plain reading of it."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel

from remarkt.operators import forest, statistics
from remarkt.plans import models


def brute(cells, y, depth, least):
    """The prediction of each row by trying all splits of all features."""

    def split(rows, level):
        top = None
        if level < depth:
            for f in range(cells.shape[1]):
                for b in sorted(set(cells[rows, f]))[:-1]:
                    left, right = rows[cells[rows, f] <= b], rows[cells[rows, f] > b]
                    gain = y[rows].var() * len(rows) - y[left].var() * len(left) - y[right].var() * len(right)
                    if min(len(left), len(right)) >= least and gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                        top = (gain, left, right)
        if top:
            split(top[1], level + 1)
            split(top[2], level + 1)
        else:
            out[rows] = y[rows].mean()

    out = np.zeros(len(y))
    split(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("nodes", [1 << 10, 2])
def test_a_tree_equals_brute_force_on_single_rows(monkeypatch, nodes):
    monkeypatch.setattr(forest, "NODES", nodes)
    rng = np.random.default_rng(1)
    cells, n = rng.integers(0, 5, (60, 4)).astype(np.uint8), rng.integers(0, 4, 60)
    y = cells[:, 0] * 10.0 + cells[:, 1] * cells[:, 2] + rng.random(60)
    tree = forest.grow(cells, y, n, 5, 2, 4, rng)
    singly = np.repeat(np.arange(60), n)
    assert tree.score(cells[singly]) == pytest.approx(brute(cells[singly], y[singly], 5, 2))
    assert tree.depth <= 5 and np.argmax(tree.gains) == 0


def test_edges():
    assert forest.edges_of(np.array([3.0, 1.0, 1.0]), np.array([1, 1, 1])).tolist() == [2.0]
    many = forest.edges_of(np.arange(1000.0), np.ones(1000))
    assert len(many) == forest.BINS - 1 and abs(np.diff(many) - 1000 / forest.BINS).max() <= 1
    heavy = forest.edges_of(np.arange(1000.0), np.where(np.arange(1000) == 500, 100_000, 1))
    assert 499.5 in heavy or 500.5 in heavy


def test_metrics_of_merged_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1.0, 2.5, None]), rng.random(), rng.randrange(1, 5)) for _ in range(40)]
    merged = statistics.regression_metrics(spark.createDataFrame(rows, "y double, p double, n long"), "y", "p", "n").first()
    singly = statistics.regression_metrics(spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "y double, p double"), "y", "p").first()
    assert tuple(merged) == pytest.approx(tuple(singly))
    assert statistics.regression_metrics(spark.createDataFrame([], "y double, p double, n long"), "y", "p", "n").first().n == 0


def test_equal_rows_are_learnt_from_as_one(spark, monkeypatch):
    """100 times the rows leave the trees the same table to learn from."""
    seen, fit = [], forest.fit

    def counting(df, *a, **k):
        seen.append((df.count(), df.agg({"n": "sum"}).first()[0]))
        return fit(df, *a, **k)

    monkeypatch.setattr(forest, "fit", counting)
    made = spark.range(30_000).selectExpr("cast(id as string) as key", "'M' as model_line", "cast(60 + id % 40 as double) as battery_percentage", "case when id % 1000 < 999 then cast(20000 + (id % 40) * 50 as double) end as price", "'128' as storage")
    model, errors = models.train_price(made, {}, "key", trees=5, depth=8)
    found = {r.part: r for r in errors.collect()}
    # every 1000th has no price
    assert seen == [(40, found["train"].n)] and found["train"].n + found["test"].n == 29_970
    assert found["test"].r2 > 0.9 and isinstance(model.forest, forest.Forest)
    assert len(model.forest.trees) == 5


def test_more_unlike_rows_than_a_task_takes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(forest, "ROWS", 10)
    df = spark.range(300).selectExpr("cast(id as string) as key", "'M' as model_line", "cast(60 + id % 40 as double) as battery_percentage", "cast(20000 + (id % 40) * 50 as double) as price", "'128' as storage")
    model, errors = models.train_price(df, {}, "key", trees=5, depth=5)
    assert isinstance(model.forest, RandomForestRegressionModel) and all(r.r2 > 0.8 for r in errors.collect())
    model.save(str(tmp_path / "m"))
    back = models.PriceModel.load(spark, str(tmp_path / "m"), {})
    assert back.predict(df.limit(1)).first().prediction == model.predict(df.limit(1)).first().prediction and len(back.importance()) == 10
