"""Bindings: multiclass model, its validation metrics and tree attribution.

Orders are the examples (features as in the explanation binding), the order
state the class. Model fitting is iterative, so these are rows-only checks;
additivity and metric identities are unit-tested.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.boosted import margin_attribution, train_boosted, validation_losses
from ..operators.metrics import classification_report, log_loss
from ..operators.model import train_multiclass, tree_attribution
from ..operators.trees import attribution_rows
from .common import r6, t
from .explain import FEATURES, SQL_EXAMPLES, examples
from .registry import query


ALL_FEATURES = [*FEATURES, "o_orderpriority"]


def labelled_examples(spark, sf):
    """The examples with their class and a text feature that is missing for some."""
    d = examples(spark, sf, "o_orderstatus", "o_orderpriority")
    return d.withColumn("o_orderpriority", F.when(F.col("example_index") % 11 != 0, F.col("o_orderpriority")))


_FITS: dict[tuple, tuple] = {}  # fits of the running application, the last few


def _once(spark, sf, kind, fit):
    """A fit made once per application and folder; several queries read it."""
    key = (spark.sparkContext.applicationId, kind, sf)
    if key not in _FITS:
        while len(_FITS) >= 4:
            del _FITS[next(iter(_FITS))]
        _FITS[key] = fit()
    return _FITS[key]


def _fit(spark, sf):
    return _once(spark, sf, "forest", lambda: _forest(spark, sf))


def _boosted(spark, sf):
    return _once(spark, sf, "boosted", lambda: train_boosted(
        labelled_examples(spark, sf), ALL_FEATURES, "o_orderstatus", "example_index", test_frac=0.2, seed=42, rounds=10, max_depth=3))


def _forest(spark, sf):
    return train_multiclass(labelled_examples(spark, sf), ALL_FEATURES, "o_orderstatus", "example_index",
                            test_frac=0.2, seed=42, num_trees=10, max_depth=5)


SQL_VALIDATION = """v AS (
  SELECT example_index, o_orderstatus FROM (
    SELECT o_orderkey AS example_index, o_orderstatus,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS rn,
           count(*) OVER (PARTITION BY o_orderstatus) AS n
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
  WHERE rn > floor(0.8 * n))"""


@query("train_multiclass", f"""WITH {SQL_VALIDATION}
SELECT example_index, o_orderstatus, true AS predicted FROM v""")
def q_train_multiclass(spark, sf):
    """The validation rows; each has one of the classes predicted."""
    _model, pred = _fit(spark, sf)
    return pred.select("example_index", "o_orderstatus", F.col("prediction").isin("F", "O", "P").alias("predicted"))


@query("train_multiclass_predictions")
def q_train_multiclass_predictions(spark, sf):
    """The validation rows with the class predicted."""
    _model, pred = _fit(spark, sf)
    return pred.select("example_index", "o_orderstatus", "prediction")


@query("model_report")
def q_model_report(spark, sf):
    _model, pred = _fit(spark, sf)
    rep = classification_report(pred, "o_orderstatus", "prediction")
    ll = log_loss(pred, "label_index", "probability").select(
        F.lit("log_loss").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("log_loss").alias("f1_score"), F.col("n").alias("support"))
    return rep.unionByName(ll).select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                                      r6("f1_score").alias("f1_score"), "support")


@query("tree_attribution", f"""WITH {SQL_VALIDATION}
SELECT example_index, CAST(3 * {len(ALL_FEATURES) + 1} AS BIGINT) AS n_values, CAST(1.0 AS DOUBLE) AS total FROM v""")
def q_tree_attribution(spark, sf):
    """Attributions of every validation row; with the base values they add up to the class
    probabilities, so to 1 over all classes."""
    model, pred = _fit(spark, sf)
    a = tree_attribution(spark, model, pred, ALL_FEATURES, "example_index")
    return a.groupBy("example_index").agg(F.count(F.lit(1)).alias("n_values"), r6(F.sum("value")).alias("total"))


@query("tree_attribution_values")
def q_tree_attribution_values(spark, sf):
    """One attribution per validation row, class and feature, and the base value of every class."""
    model, pred = _fit(spark, sf)
    return tree_attribution(spark, model, pred, ALL_FEATURES, "example_index")


@query("boosted_predictions")
def q_boosted_predictions(spark, sf):
    """The validation rows with margins, probabilities and the class predicted by the boosted model."""
    _model, pred = _boosted(spark, sf)
    return pred.select("example_index", "o_orderstatus", "prediction", "margins", "probability")


@query("boosted_losses")
def q_boosted_losses(spark, sf):
    """Validation log loss of the boosted model after every round."""
    model, pred = _boosted(spark, sf)
    return validation_losses(spark, model, pred)


@query("boosted_attribution")
def q_boosted_attribution(spark, sf):
    """Attributions of the margins of every validation row, per class and feature, and the base values."""
    model, pred = _boosted(spark, sf)
    return margin_attribution(spark, model, pred, "example_index")


# A tree of depth two over the examples: the price first, then lines (cheap orders) or discount (dear ones);
# a leaf's value is the share of status F in it.
STUMPS = (("o_totalprice", 150000.0), ("n_lines", 3.0), ("max_discount", 0.06))


@query("tree_attribution_by_paths", f"""WITH {SQL_EXAMPLES},
x AS (SELECT li.*, o_orderstatus = 'F' AS f, li.o_totalprice <= 150000 AS p, n_lines <= 3 AS l, max_discount <= 0.06 AS d
      FROM li JOIN orders ON o_orderkey = example_index),
leaf AS (SELECT p AS a, CASE WHEN p THEN l ELSE d END AS b, CAST(count(*) AS DOUBLE) AS n, avg(f::INT) AS v FROM x GROUP BY 1, 2),
z AS (SELECT *, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS za, n / sum(n) OVER (PARTITION BY a) AS zb FROM leaf),
path AS (SELECT example_index, CASE WHEN a THEN 'n_lines' ELSE 'max_discount' END AS second, v, za, zb,
                (p = a)::INT AS oa, (CASE WHEN a THEN l ELSE d END = b)::INT AS ob FROM x, z)
SELECT example_index, 'o_totalprice' AS feature, round(sum(v * (oa - za) * (ob + zb) / 2), 6) AS value FROM path GROUP BY 1
UNION ALL SELECT example_index, second, round(sum(v * (ob - zb) * (oa + za) / 2), 6) FROM path GROUP BY 1, 2
UNION ALL SELECT example_index, '__base__', round(sum(v * za * zb), 6) FROM path GROUP BY 1""")
def q_tree_attribution_by_paths(spark, sf):
    """Attributions of a given tree whose shares and leaf values come from the examples."""
    d = examples(spark, sf).join(t(spark, sf, "orders").select(F.col("o_orderkey").alias("example_index"), "o_orderstatus"), "example_index")
    low = [F.col(f) <= v for f, v in STUMPS]
    counts = d.groupBy(low[0].alias("a"), F.when(low[0], low[1]).otherwise(low[2]).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("v")).collect()  # the four leaves
    leaf = {(r.a, r.b): (r.n, r.v) for r in counts}
    (n0, v0), (n1, v1), (n2, v2), (n3, v3) = (leaf.get(k, (0, 0.0)) for k in ((True, True), (True, False), (False, True), (False, False)))
    names = [f for f, _ in STUMPS]
    tree = {"left": np.array([1, 3, 5, -1, -1, -1, -1]), "right": np.array([2, 4, 6, -1, -1, -1, -1]), "feat": np.array([0, 1, 2, -1, -1, -1, -1]),
            "thr": np.array([v for _, v in STUMPS] + [0.0] * 4), "cats": {},
            "cover": np.array([n0 + n1 + n2 + n3, n0 + n1, n2 + n3, n0, n1, n2, n3], float),
            "value": np.array([0.0, 0.0, 0.0, v0, v1, v2, v3])[:, None]}
    out = attribution_rows(d, "example_index", names, {"F": [tree]})
    return out.select("example_index", "feature", r6("value").alias("value"))
