"""Multiclass model (M1-M3) and per-class tree attribution (M4).

Training is Spark ML (random forest: native multiclass; missing values get their
own branch through a sentinel) on a stratified hash split. Attribution is the
path-dependent tree game of a fitted forest, computed exactly by one walk per tree
(``trees.py``). The forest's class probability is the mean over trees of the leaf class shares,
so per class ``sum_j phi_j + base = probability`` exactly.

The fitted trees are read back from the model's saved node table (model-sized,
read once on the driver) and broadcast; rows stream through ``mapInPandas`` in
Arrow batches, vectorised over the rows of a batch with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .broadcast import stored
from .clean import encode_categories
from .split import split_stratified
from .trees import ensemble_values, saved_nodes


# Missing feature values (null or NaN) become one low sentinel: the trees then
# learn a separate branch for them, as boosting engines with native missing
# handling do (Spark's trees reject NaN in vectors).
MISSING = -1.0e300


def model_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles: numbers as they are, text as category codes (``encode_categories``);
    missing values become ``MISSING``."""
    text = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    coded = encode_categories(df, text)
    code = {f: F.when(F.col(f + "_code") >= 0, F.col(f + "_code").cast("double")) for f in text}
    number = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    out = coded.withColumns({f: F.coalesce(code[f] if f in code else number(f), F.lit(MISSING)) for f in features})
    return out.drop(*[f + "_code" for f in text])


def train_multiclass(df: DataFrame, features: Sequence[str], label: str, key: str, test_frac: float = 0.2,
                     seed: int = 42, num_trees: int = 20, max_depth: int = 5):
    """Stratified hash split, then a random forest on the labelled rows of the training part.

    ``key`` identifies a row; rows without a label are neither trained on nor predicted. Returns
    ``(model, validation_predictions)``; the predictions carry ``key``, the label, its index,
    ``prediction`` (label text), ``pred_index``, ``probability`` as an array and the features as
    the model saw them.
    """
    # the examples are read by the category codes and the split, the labelled split by every training pass
    # and by validation: each is a stored table
    known, _ = stored(df.filter(F.col(label).isNotNull()).select(key, label, *features))
    d, _ = stored(split_stratified(model_inputs(known, features), key, label, 1.0 - test_frac, seed))
    idx = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    vec = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    rf = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=num_trees, maxDepth=max_depth,
                                seed=seed, probabilityCol="_probability", predictionCol="_pred",
                                rawPredictionCol="_raw")
    model = Pipeline(stages=[idx, vec, rf]).fit(d.filter(F.col("split") == "train"))
    val = model.transform(d.filter(F.col("split") == "validation"))
    labels = model.stages[0].labels
    lab = F.array(*[F.lit(x) for x in labels])
    out = val.select(key, label, F.col("_label").cast("int").alias("label_index"),
                     F.try_element_at(lab, F.col("_pred").cast("int") + 1).alias("prediction"),
                     F.col("_pred").cast("int").alias("pred_index"),
                     vector_to_array("_probability").alias("probability"), *features)
    return model, out


def forest_tables(spark: SparkSession, model: PipelineModel) -> list[dict]:
    """Trees of the fitted forest as numpy arrays (model-sized, read from the saved model)."""
    trees = []
    for tree in saved_nodes(spark, model.stages[-1]).values():
        cover = tree["stats"].sum(axis=1)
        trees.append(tree | {"cover": cover, "value": tree["stats"] / np.where(cover > 0, cover, 1.0)[:, None]})
    return trees


def forest_attribution_batch(trees: list[dict], X: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """phi[rows, features, classes] and base[classes] for a batch of rows: the mean over the trees."""
    phi, base = ensemble_values(trees, X)
    return phi[:, :, :n_classes] / len(trees), base[:n_classes] / len(trees)


def tree_attribution(spark: SparkSession, model: PipelineModel, df: DataFrame, features: Sequence[str],
                     key: str) -> DataFrame:
    """Long attribution ``(class_label, example_index, feature_pos, feature, value)``
    plus one ``__base__`` row per example and class (feature_pos -1)."""
    trees = forest_tables(spark, model)
    labels = list(model.stages[0].labels)
    feats = list(features)
    bc = spark.sparkContext.broadcast(trees)
    schema = T.StructType([T.StructField("class_label", T.StringType()), T.StructField("example_index", T.LongType()),
                           T.StructField("feature_pos", T.LongType()), T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType())])

    def run(batches):
        tr = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = pdf[feats].to_numpy(dtype=float)
            phi, base = forest_attribution_batch(tr, X, tr[0]["value"].shape[1])
            n, m = X.shape
            ids = pdf[key].to_numpy(dtype=np.int64)
            for c, lab in enumerate(labels):
                vals = np.concatenate([phi[:, :, c], np.full((n, 1), base[c])], axis=1)
                pos = np.tile(np.append(np.arange(m), -1), n)
                names = np.tile(np.array(feats + ["__base__"], dtype=object), n)
                yield pd.DataFrame({"class_label": lab, "example_index": np.repeat(ids, m + 1),
                                    "feature_pos": pos, "feature": names, "value": vals.reshape(-1)})

    return model_inputs(df, feats).select(F.col(key).cast("long").alias(key), *feats).mapInPandas(run, schema)
