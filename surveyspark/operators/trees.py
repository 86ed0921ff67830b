"""Exact attribution of fitted trees (M4) by one walk per tree.

The game: a feature outside a coalition sends a row down both branches, in the shares of the
training rows that took them. Its Shapley values come from one walk over the tree that carries a
path of distinct features: a split *extends* the path by its feature's share z and by whether the
row takes the branch (o), a second split on a feature first *unwinds* the older entry, and a leaf
unwinds every entry in turn, which costs the path's length squared per leaf. The path holds, for
every number of features, the weighted count of coalitions that reach the node, once for every
pattern of choices that occurs on it; rows only look up their pattern. Rows that decide alike at
every split of a tree are one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def saved_nodes(spark: SparkSession, ensemble) -> dict[int, dict]:
    """Trees of a fitted Spark ML ensemble by number, as arrays (model-sized, read from the saved model):
    children, split feature, threshold or left categories, and the rows' statistics per node."""
    path = os.path.join(checkpoint_dir(spark), f"forest-{uuid.uuid4().hex}")
    ensemble.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats", "nodeData.prediction",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories").toPandas()
    trees = {}
    for number, g in nodes.groupby("treeID"):
        n = int(g["id"].max()) + 1
        t = {"left": np.full(n, -1), "right": np.full(n, -1), "feat": np.full(n, -1), "thr": np.zeros(n), "cats": {},
             "stats": np.zeros((n, max(map(len, g["impurityStats"])))), "prediction": np.zeros(n)}
        for r in g.itertuples(index=False):
            i = int(r.id)
            t["left"][i], t["right"][i], t["feat"][i], t["prediction"][i] = r.leftChild, r.rightChild, r.featureIndex, r.prediction
            t["stats"][i, :len(r.impurityStats)] = r.impurityStats
            split = np.asarray(r.leftCategoriesOrThreshold, dtype=float)
            if r.numCategories is not None and r.numCategories >= 0:
                t["cats"][i] = split
            elif len(split):
                t["thr"][i] = split[0]
        trees[int(number)] = t
    return trees


def goes_left(tree: dict, node: int, x: np.ndarray) -> np.ndarray:
    if node in tree["cats"]:
        return np.isin(x, tree["cats"][node])
    with np.errstate(invalid="ignore"):
        return x <= tree["thr"][node]


def decisions(tree: dict, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """The distinct ways (one row each) in which rows go left or right at all splits, the way of every
    row, and the column of every split."""
    column = {int(node): k for k, node in enumerate(np.flatnonzero(tree["left"] >= 0))}
    left = np.zeros((len(X), max(1, len(column))), bool)
    for node, k in column.items():
        left[:, k] = goes_left(tree, node, X[:, tree["feat"][node]])
    packed = np.packbits(left, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))  # whole words
    keys = packed.view(np.uint64)
    _, first, way = np.unique(keys[:, 0] if keys.shape[1] == 1 else packed.view(f"V{packed.shape[1]}").reshape(-1),
                              return_index=True, return_inverse=True)
    return left[first], way, column


def leaf_of(tree: dict, ways: np.ndarray, column: dict[int, int]) -> np.ndarray:
    """The leaf that each way ends in."""
    node = np.zeros(len(ways), np.int64)
    inner = tree["left"][node] >= 0
    while inner.any():
        at = np.flatnonzero(inner)
        k = np.array([column[int(x)] for x in node[at]])
        node[at] = np.where(ways[at, k], tree["left"][node[at]], tree["right"][node[at]])
        inner = tree["left"][node] >= 0
    return node


class _Path:
    """Distinct features of a path with their shares, and per pattern (column) their choices and the weights
    by coalition size; ``pattern`` is the column of each row."""

    def __init__(self, feats: tuple, shares: tuple, chosen: tuple, weights: np.ndarray, pattern: np.ndarray):
        self.feats, self.shares, self.chosen, self.weights, self.pattern = feats, shares, chosen, weights, pattern

    def extended(self, feat: int, share: float, chosen: np.ndarray, takes: np.ndarray) -> _Path:
        """``chosen``: choices at older splits on ``feat``; ``takes``: does a row take this branch?"""
        size, columns = self.weights.shape
        code = 2 * self.pattern + takes
        present = np.bincount(code, minlength=2 * columns) > 0
        old, taken = np.divmod(np.flatnonzero(present), 2)
        chosen = chosen[old] * taken
        down = np.arange(size, 0, -1)[:, None] / (size + 1)
        before = self.weights[:, old]
        w = np.zeros((size + 1, len(old)))
        w[:-1] = share * before * down
        w[1:] += chosen * before * down[::-1]
        return _Path((*self.feats, feat), (*self.shares, share), (*(c[old] for c in self.chosen), chosen), w,
                     (np.cumsum(present) - 1)[code])

    def _unwound(self, k: int) -> np.ndarray:
        """The weights without entry k: extension read backwards, from the top where the entry is
        chosen and from the bottom where it is not."""
        size, share, chosen = len(self.weights), self.shares[k], self.chosen[k] > 0
        out = np.empty((size - 1, self.weights.shape[1]))
        above = self.weights[-1]
        for j in range(size - 2, -1, -1):
            taken = above * size / (j + 1)
            out[j] = taken
            above = self.weights[j] - taken * share * (size - 1 - j) / size
        if share > 0 and not chosen.all():
            rest = self.weights[:-1, ~chosen] * size / (share * np.arange(size - 1, 0, -1)[:, None])
            out[:, ~chosen] = rest
        elif share == 0:
            out[:, ~chosen] = 0.0  # weightless: no training row went this way
        return out

    def without(self, k: int) -> _Path:
        cut = lambda x: x[:k] + x[k + 1:]
        return _Path(cut(self.feats), cut(self.shares), cut(self.chosen), self._unwound(k), self.pattern)

    def at_leaf(self, k: int) -> np.ndarray:
        return self._unwound(k).sum(0) * (self.chosen[k] - self.shares[k])


def tree_values(tree: dict, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi[rows, features, outputs] and base[outputs] of one tree, whose ``value`` holds the outputs of
    every node and whose ``cover`` the training rows."""
    ways, way, column = decisions(tree, X)
    outputs = tree["value"].shape[1]
    phi, base = np.zeros((X.shape[1], len(ways), outputs)), np.zeros(outputs)
    stack = [(0, 1.0, _Path((), (), (), np.ones((1, 1)), np.zeros(len(ways), np.int64)))]
    while stack:
        node, share, path = stack.pop()
        value = tree["value"][node]
        if tree["left"][node] < 0:
            base += share * value
            for k, f in enumerate(path.feats):
                phi[f] += np.take(path.at_leaf(k)[:, None] * value, path.pattern, axis=0)
            continue
        feat, own, chosen = int(tree["feat"][node]), 1.0, np.ones(path.weights.shape[1])
        if feat in path.feats:
            k = path.feats.index(feat)
            own, chosen, path = path.shares[k], path.chosen[k], path.without(k)
        left = ways[:, column[node]]
        for child, takes in ((tree["left"][node], left), (tree["right"][node], ~left)):
            part = tree["cover"][child] / tree["cover"][node] if tree["cover"][node] > 0 else 0.0
            stack.append((int(child), share * part, path.extended(feat, own * part, chosen, takes)))
    return phi[:, way].swapaxes(0, 1), base


def ensemble_values(trees: list[dict], X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the trees of ``tree_values``."""
    phi = base = None
    for tree in trees:
        p, b = tree_values(tree, X)
        phi, base = (p, b) if phi is None else (phi + p, base + b)
    return phi, base


def attribution_rows(inputs: DataFrame, key: str, features: Sequence[str], ensembles: dict[str, list[dict]]) -> DataFrame:
    """Long attribution ``(class_label, example_index, feature_pos, feature, value)`` of the summed trees of
    every class (one output each), and one ``__base__`` row per example and class (feature_pos -1). Rows
    stream through the broadcast trees in Arrow batches; features are numbers without nulls."""
    features = list(features)
    bc = inputs.sparkSession.sparkContext.broadcast(ensembles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            X, ids = pdf[features].to_numpy(float), pdf[key].to_numpy(np.int64)
            for name, trees in bc.value.items():
                phi, base = ensemble_values(trees, X)
                values = np.concatenate([phi[:, :, 0], np.full((len(X), 1), base[0])], axis=1)
                yield pd.DataFrame({
                    "class_label": name, "example_index": np.repeat(ids, len(features) + 1),
                    "feature_pos": np.tile(np.append(np.arange(len(features)), -1), len(X)),
                    "feature": np.tile(np.array([*features, "__base__"], dtype=object), len(X)), "value": values.reshape(-1)})

    return inputs.select(F.col(key).cast("bigint").alias(key), *features).mapInPandas(
        run, "class_label string, example_index bigint, feature_pos bigint, feature string, value double")
