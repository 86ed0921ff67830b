import math

import pytest
from pyspark.sql import functions as F

from surveyspark.operators.attribution import (attribution_text, explode_attribution_json, explode_attrs,
                                               linear_attribution, nest_attribution, parse_attribution_text,
                                               to_json_lines, top_features)
from surveyspark.operators.compare import box_summary, t_two_sided_p, union_runs, welch_ttest
from surveyspark.operators.generate import batch_generate, explanation_request, head_per_group
from surveyspark.operators.metrics import accuracy_f1, classification_report, log_loss
from tests.conftest import SF001


def test_linear_attribution_is_additive(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(50)], "k long, a double, b double")
    w = {"c0": {"a": 2.0, "b": -0.5}, "c1": {"a": -1.0, "b": 0.25}}
    long = linear_attribution(df, "k", ["a", "b"], w)
    means = df.agg(F.avg("a"), F.avg("b")).first()
    score = long.groupBy("class_label", "example_index").agg(F.sum("value").alias("s")).collect()
    rows = {r["k"]: r for r in df.collect()}
    for r in score:
        x = rows[r["example_index"]]
        ww = w[r["class_label"]]
        exact = ww["a"] * (x["a"] - means[0]) + ww["b"] * (x["b"] - means[1])
        assert abs(r["s"] - exact) < 1e-9


def test_top_features_ties_and_text(spark):
    long = spark.createDataFrame(
        [("0", 1, 0, "a_b", 0.5), ("0", 1, 1, "c", -0.5), ("0", 1, 2, "d", 0.125), ("0", 1, 3, "e", 0.0),
         ("1", 2, 0, "x", 2.675)], "class_label string, example_index long, feature_pos long, feature string, value double")
    top = top_features(long, 3).filter("example_index = 1").orderBy("rank").collect()
    assert [(r["feature"], r["value"]) for r in top] == [("a b", 0.5), ("c", -0.5), ("d", 0.125)]
    txt = {r["example_index"]: r["shap_text"] for r in attribution_text(nest_attribution(long), 10).collect()}
    assert txt[1] == ('The most important features are: "a b" with 0.50 (positive), "c" with -0.50 (negative), '
                      '"d" with 0.12 (positive), "e" with 0.00 (negative).')
    assert txt[2] == 'The most important features are: "x" with 2.67 (positive).'


def test_json_roundtrip_identity(spark):
    long = spark.createDataFrame(
        [("0", 3, 0, "f1", 1e-12), ("0", 3, 1, "f 2", -0.0), ("2", 10, 0, "f1", 7.5)],
        "class_label string, example_index long, feature_pos long, feature string, value double")
    back = explode_attribution_json(to_json_lines(nest_attribution(long)))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in long.collect())
    m = spark.createDataFrame([("{'a b': 0.5, 'c': -1e-05}",)], "t string").select(
        parse_attribution_text("t").alias("m")).first()["m"]
    assert m == {"a b": 0.5, "c": -1e-05}


def test_generation_and_head(spark):
    long = spark.createDataFrame([(c, i, 0, "f", float(i)) for c in ("0", "1") for i in range(150)],
                                 "class_label string, example_index long, feature_pos long, feature string, value double")
    heads = head_per_group(attribution_text(nest_attribution(long)), "class_label", "example_index", 100)
    assert heads.count() == 200
    asked = spark.sparkContext.accumulator(0)

    def answer(prompts):
        asked.add(len(prompts))
        return prompts + " OK"

    own = batch_generate(explanation_request(heads, style="plain"), answer, out="answer")
    assert {r["answer"] for r in own.collect()} == {"OK"}
    assert own.groupBy("answer").count().first()["count"] == 200 and asked.value == 200   # asked once, read twice
    own = own.first()
    assert own["answer"] == "OK"


def test_classification_report_and_loss(spark):
    df = spark.createDataFrame([(0, 0, [0.9, 0.1]), (0, 1, [0.4, 0.6]), (1, 1, [0.0, 1.0]), (1, 2, [1.0, 0.0])],
                               "label int, pred int, probability array<double>")
    rep = {r["class"]: r for r in classification_report(df, "label", "pred").collect()}
    assert rep["0"]["precision"] == 1.0 and rep["0"]["recall"] == 0.5
    assert rep["2"]["precision"] == 0.0 and rep["2"]["support"] == 0   # predicted, never true
    assert rep["accuracy"]["f1_score"] == 0.5
    a = accuracy_f1(df, "label", "pred").first()
    assert a["accuracy"] == 0.5
    assert a["f1_weighted"] == pytest.approx((2 * (2 / 3) + 2 * 0.5) / 4)
    ll = log_loss(df.filter("label < 2"), "label", "probability").first()["log_loss"]
    exp = (-math.log(0.9) - math.log(0.4) - math.log(1.0) - math.log(1e-15)) / 4
    assert ll == pytest.approx(exp)


def test_welch_and_box(spark):
    a = [1.0, 2.0, 3.0, 4.0, 10.0]
    b = [2.0, 2.5, 2.0]
    runs = union_runs({"a": spark.createDataFrame([(x,) for x in a], "v double"),
                       "b": spark.createDataFrame([(x,) for x in b], "v double"),
                       "c": spark.createDataFrame([(1.0,)], "v double")})
    w = welch_ttest(runs, "model", "v", "a", "b").first()
    ma, mb = sum(a) / 5, sum(b) / 3
    va = sum((x - ma) ** 2 for x in a) / 4
    vb = sum((x - mb) ** 2 for x in b) / 2
    assert w["t_stat"] == pytest.approx((ma - mb) / math.sqrt(va / 5 + vb / 3))
    assert welch_ttest(runs, "model", "v", "a", "c").first()["t_stat"] is None   # run of size 1
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "model string, v double")
    assert welch_ttest(flat, "model", "v", "a", "b").first()["t_stat"] is None   # nothing varies
    assert t_two_sided_p(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided_p(0.0, 5.0) == pytest.approx(1.0)
    bx = {r["model"]: r for r in box_summary(runs, "model", "v").collect()}
    assert (bx["a"]["q1"], bx["a"]["median"], bx["a"]["q3"]) == (2.0, 3.0, 4.0)
    assert bx["a"]["n_outliers"] == 1 and bx["a"]["whisker_high"] == 4.0


def test_p_value_in_expressions(spark):
    from surveyspark.operators.compare import two_sided_p
    cases = [(t, v) for t in (0.0, 1e-6, 0.3, -1.0, 2.0, 5.5, -30.0, 1e6) for v in (1.0, 1.7, 2.0, 10.0, 333.3, 54321.0, 2e6)]
    df = spark.createDataFrame([*cases, (float("inf"), 3.0), (float("nan"), 3.0), (None, 3.0), (1.0, None)], "t double, v double")
    for r in df.withColumn("p", two_sided_p(F.col("t"), F.col("v"))).collect():
        want = t_two_sided_p(r.t, r.v)
        assert r.p is None if want is None else r.p == pytest.approx(want, rel=1e-8, abs=1e-14), r
    plan = df.withColumn("p", two_sided_p(F.col("t"), F.col("v")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_json_text_of_tool_arguments(spark):
    import json

    from surveyspark.operators.chat import json_text
    values = [{"a": 1, "b": [1, 2.5, -3e-7, None, True, False], "c": {"d": {}, "e": []}}, [], {}, "x: y, z", "q\"\\ü\n\u2028{}[],:", 12, None, True,
              {"k,:": "v , w : x", "ключ": "  two  spaces "}]
    texts = [f(v) for v in values for f in (json.dumps, lambda v: json.dumps(v, indent=3, ensure_ascii=False), lambda v: json.dumps(v, separators=(",", ":")))]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", json_text(F.col("x")).alias("y")).orderBy("k").collect()
    assert [r.y for r in got] == [json.dumps(json.loads(t), ensure_ascii=False) for t in texts]


def test_entry_and_every_query_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns == ["model", "n", "mean_cosine_similarity"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for name, fn in qs.items():
        d = fn(spark, SF001)
        d.write.format("noop").mode("overwrite").save()
        assert len(d.columns) == len(set(d.columns)), name


def test_tree_attribution_is_additive(spark):
    import random
    from surveyspark.operators.model import tree_attribution, train_multiclass
    rng = random.Random(0)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.randint(0, 4), rng.random()
        y = "x" if a + 0.1 * b > 0.8 else ("y" if c > 0.5 else "z")
        rows.append((i, a, float(b), c if i % 17 else float("nan"), y))
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y string")
    model, pred = train_multiclass(df, ["a", "b", "c"], "y", "k", num_trees=4, max_depth=4)
    att = tree_attribution(spark, model, df.join(pred.select("k"), "k"), ["a", "b", "c"], "k")
    sums = {(r["class_label"], r["example_index"]): r["s"]
            for r in att.groupBy("class_label", "example_index").agg(F.sum("value").alias("s")).collect()}
    labels = model.stages[0].labels
    for r in pred.collect():
        for ci, lab in enumerate(labels):
            assert abs(sums[(lab, r["k"])] - r["probability"][ci]) < 1e-9


def test_model_queries_return_predictions_and_attributions(spark):
    from surveyspark.plans import QUERIES
    from surveyspark.plans.model import ALL_FEATURES, _fit

    sf = "/root/testdata/sf0.001"
    model, pred = _fit(spark, sf)
    rows = pred.select("example_index", "prediction", "probability").collect()
    labels = model.stages[0].labels
    got = QUERIES["train_multiclass_predictions"](spark, sf).collect()
    assert {r.example_index: r.prediction for r in got} == {r.example_index: r.prediction for r in rows}
    values = {}
    for r in QUERIES["tree_attribution_values"](spark, sf).collect():
        values.setdefault((r.example_index, r.class_label), {})[r.feature] = r.value
    assert len(values) == len(labels) * len(rows)
    for r in rows:
        for label, p in zip(labels, r.probability):
            assert set(values[r.example_index, label]) == {*ALL_FEATURES, "__base__"}
            assert abs(sum(values[r.example_index, label].values()) - p) < 1e-6


def test_tree_attribution_matches_brute_force_shapley(spark):
    import itertools
    import random

    import numpy as np
    from surveyspark.operators.model import forest_attribution_batch, forest_tables, train_multiclass
    rng = random.Random(1)
    rows = [(i, rng.random(), float(rng.randint(0, 3)), rng.random(), rng.choice("pq"))
            for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y string")
    model, _ = train_multiclass(df, ["a", "b", "c"], "y", "k", num_trees=2, max_depth=4)
    trees = forest_tables(spark, model)
    X = np.array([[r[1], r[2], r[3]] for r in rows[:25]])
    phi, base = forest_attribution_batch(trees, X, trees[0]["value"].shape[1])

    def expval(tree, x, S, node=0):
        if tree["left"][node] < 0:
            return tree["value"][node]
        lft, rgt, f = tree["left"][node], tree["right"][node], tree["feat"][node]
        if f in S:
            go_left = x[f] <= tree["thr"][node]
            return expval(tree, x, S, lft if go_left else rgt)
        c = tree["cover"]
        return (c[lft] * expval(tree, x, S, lft) + c[rgt] * expval(tree, x, S, rgt)) / c[node]

    m = 3
    for r in range(len(X)):
        for j in range(m):
            others = [f for f in range(m) if f != j]
            tot = 0.0
            for size in range(m):
                for S in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    gain = np.mean([expval(t, X[r], set(S) | {j}) - expval(t, X[r], set(S)) for t in trees], axis=0)
                    tot = tot + w * gain
            assert np.allclose(phi[r, j], tot, atol=1e-12)


def test_exact_quantiles_match_percentile(spark):
    import random
    from surveyspark.operators.compare import exact_quantiles
    rng = random.Random(2)
    rows = [("hot", 5.0) for _ in range(3000)] + [("hot", rng.random()) for _ in range(2000)]
    rows += [("b", float(rng.randint(0, 50))) for _ in range(777)] + [("c", 1.5)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in
           exact_quantiles(df, ["g"], "v", probs, accuracy=100).collect()}
    exp = {r["g"]: r["q"] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect() if r["q"] is not None}
    assert set(got) == set(exp)
    for g in exp:
        assert got[g] == pytest.approx(exp[g], abs=1e-12), g
