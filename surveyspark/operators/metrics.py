"""Classification metrics from a confusion table: accuracy and weighted F1 (A7),
classification report (A8), multi-class log loss (A10).

The only pass over the predictions is one grouped count by (label, prediction)
with map-side partial aggregation; everything after works on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-15


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label"), F.col(pred).cast("string").alias("pred")) \
             .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``(class, tp, support, predicted, precision, recall, f1_score)`` for every class
    seen as a label or a prediction; 0 where a denominator is 0."""
    c = confusion(df, label, pred)
    sides = c.select(F.col("label").alias("cls"), F.when(F.col("label") == F.col("pred"), F.col("n"))
                     .otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")) \
        .unionByName(c.select(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                              F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))
    k = sides.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                 F.sum("predicted").alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    k = k.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return k.withColumn("f1_score", f1)


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``:
    ``(class, precision, recall, f1_score, support)``."""
    k = per_class(df, label, pred)
    rows = k.select(F.col("cls").alias("class"), "precision", "recall", "f1_score",
                    F.col("support").cast("bigint").alias("support"))
    n = F.sum("support")
    tot = k.agg(
        n.alias("n"), F.sum("tp").alias("tp"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
        F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / n).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1_score"),
                     F.col("n").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                          F.col("n").cast("bigint").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def accuracy_f1(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: ``accuracy`` and support-weighted ``f1_weighted``."""
    k = per_class(df, label, pred)
    n = F.sum("support")
    return k.agg((F.sum("tp") / n).alias("accuracy"),
                 (F.sum(F.col("f1_score") * F.col("support")) / n).alias("f1_weighted"),
                 n.cast("bigint").alias("n"))


def log_loss(df: DataFrame, label_index: str, probability: str) -> DataFrame:
    """Mean ``-ln p(true class)`` with p clipped at 1e-15. ``probability`` is an
    array (or ML vector converted with ``vector_to_array``) indexed by the label."""
    p = F.element_at(F.col(probability), F.col(label_index).cast("int") + 1)
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(EPS)))).alias("log_loss"), F.count(F.lit(1)).cast("bigint").alias("n"))
