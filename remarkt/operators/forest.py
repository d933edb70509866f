"""A regression forest over rows that carry counts, one task for each of its trees.

A tree's bootstrap sample holds a row that stands for n equal ones Poisson(n) times: as often as n rows drawn singly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unlike rows that the driver and each task hold at most, bins of a feature, nodes whose histograms are made at once.
ROWS, BINS, NODES = 1 << 15, 32, 1 << 10


@dataclass
class Tree:
    """Rows whose bin of a node's feature is at most upto go to the node in left, others to the one after it; a leaf's left is itself."""

    feature: np.ndarray
    upto: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    gains: np.ndarray

    def score(self, cells: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(cells), np.int64), np.arange(len(cells))
        for _ in range(self.depth):
            node = self.left[node] + (cells[rows, self.feature[node]] > self.upto[node])
        return self.value[node]


def edges_of(values: np.ndarray, n: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds halfway between neighbouring values: all, or those nearest to equal shares of the rows."""
    held, at = np.unique(values, return_inverse=True)
    between = (held[1:] + held[:-1]) / 2
    if len(between) < bins:
        return between
    before = np.cumsum(np.bincount(at, n))[:-1]
    wanted = np.arange(1, bins) * (n.sum() / bins)
    k = np.clip(np.searchsorted(before, wanted), 1, len(before) - 1)
    return np.unique(between[np.where(wanted - before[k - 1] < before[k] - wanted, k - 1, k)])


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, np.asarray(c, float)) for c, e in zip(columns, edges, strict=True)], axis=1).astype(np.uint8)


def grow(cells: np.ndarray, y: np.ndarray, n: np.ndarray, depth: int, least: int, features: int, rng: np.random.Generator) -> Tree:
    """A tree by variance, each node split on the best of so many features drawn for it; sides have least rows at least."""
    some = n > 0
    cells, n = cells[some], n[some].astype(float)
    whole = float((y[some] * n).sum() / max(n.sum(), 1.0))
    y = y[some] - whole
    tiny, gains = 1e-12 * float((n * y * y).sum()), np.zeros(cells.shape[1])
    feature, upto, left, value, deepest = [0], [BINS], [0], [whole], 0
    open_ = [(0, np.zeros(1, np.int64), np.arange(len(y)), np.zeros(len(y), np.int64))] if len(y) else []
    while open_:
        level, nodes, rows, at = open_.pop()
        k = len(nodes)
        picked = np.sort(np.argsort(rng.random((k, cells.shape[1])), axis=1)[:, :features], axis=1)
        key = ((at[:, None] * features + np.arange(features)) * BINS + cells[rows[:, None], picked[at]]).ravel()
        w, wy = n[rows], n[rows] * y[rows]
        c, s = (np.bincount(key, np.repeat(x, features), k * features * BINS).reshape(k, features, BINS).cumsum(2) for x in (w, wy))
        all_c, all_s = (np.bincount(at, x, k)[:, None, None] for x in (w, wy))
        fits = (c >= least) & (all_c - c >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, s * s / c + (all_s - s) ** 2 / (all_c - c) - all_s**2 / all_c, 0.0).reshape(k, -1)
        top = gain.argmax(1)
        split = np.flatnonzero(gain[np.arange(k), top] > tiny)
        if not len(split):
            continue
        j, b = top[split] // BINS, top[split] % BINS
        f = picked[split, j]
        np.add.at(gains, f, gain[split, top[split]])
        below = len(value) + 2 * np.arange(len(split))
        lc, ls = c[split, j, b], s[split, j, b]
        rc, rs = all_c[split, 0, 0] - lc, all_s[split, 0, 0] - ls
        for i, node in enumerate(nodes[split].tolist()):
            feature[node], upto[node], left[node] = int(f[i]), int(b[i]), int(below[i])
            feature += [0, 0]
            upto += [BINS, BINS]
            left += [int(below[i]), int(below[i]) + 1]
            value += [whole + float(ls[i] / lc[i]), whole + float(rs[i] / rc[i])]
        deepest = max(deepest, level + 1)
        if level + 1 == depth:
            continue
        new = np.full(k, -1)
        new[split] = 2 * np.arange(len(split))
        on = new[at] >= 0
        rows, at = rows[on], at[on]
        where = new[at] // 2
        child = new[at] + (cells[rows, f[where]] > b[where])
        numbers = (below[:, None] + np.arange(2)).ravel()
        for lo in range(0, len(numbers), NODES):
            own = (child >= lo) & (child < lo + NODES)
            open_.append((level + 1, numbers[lo : lo + NODES], rows[own], child[own] - lo))
    return Tree(np.array(feature), np.array(upto), np.array(left), np.array(value), deepest, gains)


@dataclass
class Forest:
    names: tuple[str, ...]
    edges: list[np.ndarray]
    trees: list[Tree]

    def score(self) -> Column:
        """The mean of the trees, of the columns in names."""
        edges, trees = self.edges, self.trees

        @F.pandas_udf("double")
        def mean(*columns: pd.Series) -> pd.Series:
            cells = binned(columns, edges)
            return pd.Series(sum(t.score(cells) for t in trees) / len(trees))

        return mean(*(F.col(c).cast("double") for c in self.names))

    def importance(self) -> np.ndarray:
        """Each feature's share of the gains, the mean over the trees."""
        shares = [t.gains / t.gains.sum() for t in self.trees if t.gains.sum() > 0]
        return np.mean(shares, axis=0) if shares else np.zeros(len(self.names))

    def dumps(self) -> str:
        trees = [[t.feature.tolist(), t.upto.tolist(), t.left.tolist(), t.value.tolist(), t.depth, t.gains.tolist()] for t in self.trees]
        return json.dumps({"names": self.names, "edges": [e.tolist() for e in self.edges], "trees": trees})

    @staticmethod
    def loads(text: str) -> Forest:
        x = json.loads(text)
        trees = [Tree(*(np.array(a, np.int64) for a in t[:3]), np.array(t[3], float), t[4], np.array(t[5], float)) for t in x["trees"]]
        return Forest(tuple(x["names"]), [np.array(e, float) for e in x["edges"]], trees)


def fit(df: DataFrame, names: Sequence[str], label: str, count: str, trees: int, depth: int, least: int = 2, seed: int = 42) -> Forest:
    """A forest on unlike rows, ROWS at most, that each stand for count equal ones; a third of the features is drawn for a node."""
    held = df.select(F.col(label).cast("double"), F.col(count).cast("bigint"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names))).toArrow()
    if not held.num_rows:
        raise ValueError("no rows to learn from")
    y, n, *columns = (np.asarray(c) for c in held.columns)
    # the same trees whatever the order in which rows came
    order = np.lexsort([n, y, *columns])
    y, n, columns = y[order], n[order], [c[order] for c in columns]
    edges = [edges_of(c, n) for c in columns]
    cells, features = binned(columns, edges), -(-len(names) // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, t])
                tree = grow(cells, y, rng.poisson(n), depth, least, features, rng)
                yield pa.RecordBatch.from_arrays([pa.array([t]), *(pa.array([x.tolist()]) for x in (tree.feature, tree.upto, tree.left, tree.value)), pa.array([tree.depth]), pa.array([tree.gains.tolist()])], names=NAMES)

    spark = df.sparkSession
    grown = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "tree bigint, feature array<bigint>, upto array<bigint>, left array<bigint>, value array<double>, depth bigint, gains array<double>")
    found = grown.toArrow().sort_by("tree").to_pylist()
    return Forest(tuple(names), edges, [Tree(*(np.array(r[c]) for c in NAMES[1:5]), r["depth"], np.array(r["gains"])) for r in found])


NAMES = ["tree", "feature", "upto", "left", "value", "depth", "gains"]
