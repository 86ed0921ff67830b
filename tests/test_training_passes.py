"""Training reads its examples once, however many passes it makes over them."""

import random

import pytest

from surveyspark.operators.boosted import train_boosted
from surveyspark.operators.model import train_multiclass


@pytest.mark.parametrize("train", [train_boosted, train_multiclass])
def test_examples_are_made_once(spark, train):
    rng = random.Random(3)
    made = [(i, rng.random(), rng.choice(["u", "v", None]), rng.choice("pq")) for i in range(200)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(made, "k long, a double, b string, y string").mapInPandas(count, "k long, a double, b string, y string")
    small = {"rounds": 2} if train is train_boosted else {"num_trees": 2}
    _, predictions = train(df, ["a", "b"], "y", "k", max_depth=2, **small)
    assert sorted(predictions.columns)[:2] == ["a", "b"] and 38 <= predictions.count() <= 42
    assert seen.value == len(made)


def test_orders_are_read_once_for_their_examples(spark):
    from conftest import SF001

    from surveyspark.plans.model import labelled_examples

    d = labelled_examples(spark, SF001)
    assert len(d.inputFiles()) == 2 and d._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
    assert {r.example_index % 11 == 0 for r in d.filter("o_orderpriority is null").collect()} == {True}
