"""Boosted multiclass model, its losses by round, and exact attribution of its margins."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import boosted, trees
from surveyspark.operators.metrics import log_loss
from surveyspark.operators.model import train_multiclass


def random_tree(rng, depth, features, outputs=2):
    t = {"left": [], "right": [], "feat": [], "thr": [], "cover": [], "value": [], "cats": {}}

    def grow(level, cover):
        node = len(t["left"])
        for k, v in (("left", -1), ("right", -1), ("feat", -1), ("thr", 0.0), ("cover", cover), ("value", rng.normal(size=outputs))):
            t[k].append(v)
        if level and cover > 1 and rng.random() < 0.9:
            t["feat"][node], part = int(rng.integers(features)), int(rng.integers(1, cover))
            if rng.random() < 0.3:
                t["cats"][node] = rng.choice(4, size=2, replace=False) / 4
            else:
                t["thr"][node] = rng.integers(4) / 4
            t["left"][node] = grow(level - 1, part)
            t["right"][node] = grow(level - 1, cover - part)
        return node

    grow(depth, 200)
    return {k: v if k == "cats" else np.array(v) for k, v in t.items()}


def game(tree, x, known, node=0):
    """Expected value of the tree if only the features in ``known`` are."""
    if tree["left"][node] < 0:
        return tree["value"][node]
    children = tree["left"][node], tree["right"][node]
    if tree["feat"][node] in known:
        return game(tree, x, known, children[0] if trees.goes_left(tree, node, x[[tree["feat"][node]]])[0] else children[1])
    return sum(tree["cover"][c] / tree["cover"][node] * game(tree, x, known, c) for c in children)


def test_values_are_shapley_values():
    rng = np.random.default_rng(4)
    for number in range(30):
        m = 4
        tree = random_tree(rng, 1 + number % 6, m)
        X = rng.integers(0, 4, size=(12, m)) / 4
        phi, base = trees.tree_values(tree, X)
        assert np.allclose(base, game(tree, X[0], set()))
        for x, own in zip(X, phi):
            for j in range(m):
                rest = [f for f in range(m) if f != j]
                want = sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                           * (game(tree, x, {*s, j}) - game(tree, x, {*s})) for k in range(m) for s in itertools.combinations(rest, k))
                assert np.allclose(own[j], want, atol=1e-12)


def test_branches_without_training_rows():
    tree = {"left": np.array([1, -1, -1]), "right": np.array([2, -1, -1]), "feat": np.array([0, -1, -1]), "thr": np.array([0.5, 0, 0]),
            "cover": np.array([10.0, 10.0, 0.0]), "value": np.array([[0.0], [1.0], [5.0]]), "cats": {}}
    phi, base = trees.tree_values(tree, np.array([[0.0], [1.0]]))
    assert base[0] == 1.0 and phi[:, 0, 0].tolist() == [0.0, 4.0]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(0)
    rows = []
    for i in range(1500):
        a, b, c = rng.random(), rng.choice(["u", "v", "w", "x", None]), rng.random() if i % 13 else None
        y = "p" if (b in ("u", "x")) != (a > 0.6) else "q" if c is None or c > 0.4 else "r"
        rows.append((i, a, b, c, y if rng.random() < 0.95 else rng.choice("pqr")))
    rows += [(5000, 0.5, "u", 0.5, None)]
    df = spark.createDataFrame(rows, "k long, a double, b string, c double, y string")
    model, predictions = boosted.train_boosted(df, ["a", "b", "c"], "y", "k", rounds=8, max_depth=4)
    return df, model, predictions


def test_predictions(fitted):
    df, model, predictions = fitted
    rows = predictions.collect()
    assert model.labels == ["p", "q", "r"] and all(e.getNumTrees >= 1 for e in model.ensembles)
    assert 280 <= len(rows) <= 320 and all(abs(sum(r.probability) - 1) < 1e-12 for r in rows)
    assert all(r.prediction == model.labels[r.pred_index] and r.probability[r.pred_index] == max(r.probability) for r in rows)
    assert sum(r.prediction == r.y for r in rows) / len(rows) > 0.88
    nominal = [i for e in model.ensembles for t in trees.saved_nodes(df.sparkSession, e).values() for i in t["cats"]]
    assert nominal  # text is split by sets of categories


def test_loss_by_round(spark, fitted, tmp_path):
    import duckdb

    df, model, predictions = fitted
    losses = {r.round: r.log_loss for r in boosted.validation_losses(spark, model, predictions).collect()}
    assert sorted(losses) == list(range(1, max(e.getNumTrees for e in model.ensembles) + 1))
    predictions.select("k", "label_index", "probability").write.parquet(str(tmp_path / "p"))
    (want,), = duckdb.sql(f"SELECT avg(-ln(greatest(probability[label_index + 1], 1e-15))) FROM '{tmp_path}/p/*.parquet'").fetchall()
    assert losses[max(losses)] == pytest.approx(want, abs=1e-9)
    assert losses[max(losses)] < losses[1]
    forest = train_multiclass(df, ["a", "b", "c"], "y", "k")[1]
    assert want <= log_loss(forest, "label_index", "probability").first()["log_loss"]


def test_attribution_adds_up_to_the_margin(spark, fitted):
    _, model, predictions = fitted
    att = boosted.margin_attribution(spark, model, predictions, "k")
    sums = {(r.class_label, r.example_index): r.s for r in att.groupBy("class_label", "example_index").agg(F.sum("value").alias("s")).collect()}
    for r in predictions.collect():
        for name, margin in zip(model.labels, r.margins):
            assert sums[name, r.k] == pytest.approx(margin, abs=1e-9)


def test_a_category_not_seen_is_missing(spark, fitted):
    _, model, _ = fitted
    new = spark.createDataFrame([(1, 0.2, "never", 0.5), (2, 0.2, None, 0.5)], "k long, a double, b string, c double")
    one, two = model.predict(model.inputs(new)).orderBy("k").collect()
    assert one.margins == two.margins
