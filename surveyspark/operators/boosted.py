"""Boosted multiclass model (M1-M3) and attribution of its raw scores (M4).

One boosted ensemble per class (that class against the rest), each round's trees fitted by Spark ML to
the errors of the rounds before; the validation rows stop an ensemble when its rounds stop helping. A
row's raw score (margin) for a class is the weighted sum of that ensemble's trees; the class
probabilities are the ensembles' own probabilities, normalised to one.

Text features are nominal: their categories are split as sets, and a missing value is a category of
its own. Missing numbers are one value below all others, so a split can give them a branch of their
own. A text feature of more categories than ``max_categories`` is split by code order.

The trees are read back once from the saved models (model-sized); rows stream through them in Arrow
batches: margins after every round give the log loss of every round, one walk per tree
(``trees.py``) the attributions. Per class they add up to the margin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .clean import category_codes
from .broadcast import small_side, stored
from .model import MISSING
from .split import VALIDATION, split_stratified
from .trees import attribution_rows, decisions, leaf_of, saved_nodes

MAX_CATEGORIES = 256
_EPS = 1e-15  # least probability in a log loss


@dataclass
class BoostedModel:
    """A fitted model: one ensemble per label; ``codes`` maps every text feature to its category table."""

    labels: list
    features: list[str]
    ensembles: list[GBTClassificationModel]
    codes: dict[str, tuple[DataFrame, int]]
    max_categories: int

    def inputs(self, df: DataFrame) -> DataFrame:
        """Features as the trees see them: doubles, no nulls; a category not seen in training is missing."""
        for f, (table, n) in self.codes.items():
            lut = small_side(table).withColumnsRenamed({"_v": "_v_" + f, "_code": "_code_" + f})
            df = df.join(lut, F.col(f) == F.col("_v_" + f), "left")
            df = df.withColumn(f, F.coalesce(F.col("_code_" + f), F.lit(n)).cast("double")).drop("_v_" + f, "_code_" + f)
        number = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(MISSING))
        return df.withColumns({f: number(f) for f in self.features if f not in self.codes})

    def assembled(self, df: DataFrame) -> DataFrame:
        """Features as a vector whose nominal members say so."""
        d = df.withColumns({"_x_" + f: F.col(f) for f in self.features})
        for f, (_, n) in self.codes.items():
            if n < self.max_categories:
                attr = {"ml_attr": {"type": "nominal", "vals": [str(k) for k in range(n + 1)], "name": f}}
                d = d.withColumn("_x_" + f, F.col(f).alias("_x_" + f, metadata=attr))
        return VectorAssembler(inputCols=["_x_" + f for f in self.features], outputCol="_features").transform(d)

    def predict(self, inputs: DataFrame) -> DataFrame:
        """Adds ``margins`` and ``probability`` (one per label), ``pred_index`` and ``prediction``."""
        d = self.assembled(inputs)
        for k, model in enumerate(self.ensembles):
            model = model.copy().setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_p{k}").setPredictionCol(f"_y{k}")
            d = model.transform(d).withColumn(f"_m{k}", vector_to_array(f"_raw{k}")[1])
        d = d.withColumn("margins", F.array(*[F.col(f"_m{k}") for k in range(len(self.ensembles))]))
        d = d.withColumn("probability", probabilities(F.col("margins")))
        best = F.array_max(F.transform("probability", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
        d = d.withColumn("pred_index", -best["i"])
        labels = F.array(*[F.lit(x) for x in self.labels])
        keep = [*inputs.columns, "margins", "probability", "pred_index"]
        return d.select(*keep).withColumn("prediction", F.element_at(labels, F.col("pred_index") + 1))


def probabilities(margins: Column) -> Column:
    """One against the rest, 1 / (1 + exp(-2 margin)), normalised over the labels."""
    own = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(own, lambda p: p / total)


def train_boosted(df: DataFrame, features: Sequence[str], label: str, key: str, test_frac: float = 0.2, seed: int = 42,
                  rounds: int = 20, max_depth: int = 4, step: float = 0.3,
                  max_categories: int = MAX_CATEGORIES) -> tuple[BoostedModel, DataFrame]:
    """Stratified hash split of the labelled rows, one ensemble per label fitted on the training part and
    stopped by the validation part. Returns the model and the predictions of the validation part:
    ``key``, label, ``label_index`` and the columns of ``predict``. Labels are few (one ensemble each)."""
    features = list(features)
    # the examples and their split are read by many passes: each is a stored table
    known, _ = stored(df.filter(F.col(label).isNotNull()).select(key, label, *features))
    codes = {}
    for f in features:
        if isinstance(df.schema[f].dataType, T.StringType):
            table = cut_lineage(category_codes(known, f))
            codes[f] = (table, table.count())
    labels = sorted(r[0] for r in known.select(label).distinct().collect())
    model = BoostedModel(labels, features, [], codes, max_categories)
    split, _ = stored(split_stratified(model.inputs(known), key, label, 1.0 - test_frac, seed))
    rows = model.assembled(split).withColumn("_held", F.col("split") == VALIDATION)
    bins = max([32, *(n + 1 for _, n in codes.values() if n < max_categories)])
    for value in labels:
        own = rows.withColumn("_y", (F.col(label) == F.lit(value)).cast("double"))
        gbt = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=rounds, maxDepth=max_depth, stepSize=step, seed=seed,
                            maxBins=bins, validationIndicatorCol="_held", validationTol=1e-4, cacheNodeIds=False)
        model.ensembles.append(gbt.fit(own))
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    held = split.filter(F.col("split") == VALIDATION).drop("split").withColumn("label_index", index.cast("int"))
    return model, model.predict(held)


def margin_tables(spark: SparkSession, model: BoostedModel) -> list[list[dict]]:
    """Per label the trees in round order; a node's value is its share of the margin."""
    out = []
    for ensemble in model.ensembles:
        nodes, weights = saved_nodes(spark, ensemble), ensemble.treeWeights
        out.append([nodes[k] | {"cover": nodes[k]["stats"][:, 0], "value": (nodes[k]["prediction"] * weights[k])[:, None]}
                    for k in sorted(nodes)])
    return out


def round_margins(trees: list[dict], X: np.ndarray) -> np.ndarray:
    """Margins [round, row] after every round of one ensemble."""
    steps = []
    for tree in trees:
        ways, way, column = decisions(tree, X)
        steps.append(tree["value"][leaf_of(tree, ways, column), 0][way])
    return np.cumsum(steps, axis=0)


def validation_losses(spark: SparkSession, model: BoostedModel, predictions: DataFrame) -> DataFrame:
    """``(round, log_loss, n)``: log loss of the class probabilities after every round; an ensemble that
    stopped earlier keeps its last margin. Rows of ``predictions`` carry the features and ``label_index``."""
    bc = spark.sparkContext.broadcast(margin_tables(spark, model))
    features = model.features

    def run(batches):
        for pdf in batches:
            X, y = pdf[features].to_numpy(float), pdf["label_index"].to_numpy(int)
            margins = [round_margins(trees, X) for trees in bc.value]
            for k in range(max(map(len, margins))):
                own = np.array([1.0 / (1.0 + np.exp(-2.0 * m[min(k, len(m) - 1)])) for m in margins])
                p = own[y, np.arange(len(y))] / own.sum(0)
                yield pd.DataFrame({"round": [k + 1], "s": [float(-np.log(np.maximum(p, _EPS)).sum())], "n": [len(y)]})

    parts = predictions.select(*features, "label_index").mapInPandas(run, "round int, s double, n bigint")
    return parts.groupBy("round").agg((F.sum("s") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n"))


def margin_attribution(spark: SparkSession, model: BoostedModel, inputs: DataFrame, key: str) -> DataFrame:
    """Long attribution ``(class_label, example_index, feature_pos, feature, value)`` of the margins, and one
    ``__base__`` row per example and class (feature_pos -1). ``inputs`` as ``BoostedModel.inputs`` makes them."""
    trees = {str(x): t for x, t in zip(model.labels, margin_tables(spark, model))}
    return attribution_rows(inputs, key, model.features, trees)
