"""Reproducible exact-size splits (W5, W6) without a global sort.

Rows are ordered by ``md5(seed|key)``. The first ``floor(frac * n)`` rows of that order (per
stratum) are ``train``, the rest ``validation``. The same seed and keys give the same split on
any cluster and partitioning. Every row is kept: a null key comes first in the order, a null
stratum is a stratum of its own. Rows of equal key fall on the same side.

Plan: one pass counts the rows per (stratum, 4 hex digits of the hash); the bucket that holds
the last training row is found on that small table and only its rows (about n / 65,536) are
ranked to find the last training hash; every row is then labelled by one comparison against its
stratum's hash. The data itself is never shuffled while the strata fit a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .broadcast import stored_side

TRAIN, VALIDATION = "train", "validation"
PREFIX_HEX = 4


def split_order_key(key, seed: int):
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string"))), F.lit(""))


def _split(df: DataFrame, key: str, frac: float, seed: int, strata: Sequence[str], out: str) -> DataFrame:
    d = df.withColumn("_h", split_order_key(key, seed)).withColumn("_b", F.substring("_h", 1, PREFIX_HEX))
    d = d.withColumn("_s", F.struct(*[F.col(s) for s in strata]) if strata else F.lit(0))
    stratum = Window.partitionBy("_s")
    before = stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = (d.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
           .withColumn("_k", F.floor(F.lit(float(frac)) * F.sum("_c").over(stratum)))
           .filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k")))
           .select(F.col("_s").alias("_cs"), F.col("_b").alias("_cb"), (F.col("_k") - F.col("_before")).alias("_nth")))
    # one row per stratum
    cut = stored_side(cut)
    edge = d.select("_s", "_b", "_h").join(cut, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_b") == F.col("_cb")))
    nth = Window.partitionBy("_s").orderBy("_h")
    last = (edge.withColumn("_r", F.row_number().over(nth)).filter(F.col("_r") == F.col("_nth"))
            .select(F.col("_s").alias("_ls"), F.col("_h").alias("_last")))
    last = stored_side(last)
    train = F.col("_last").isNotNull() & (F.col("_h") <= F.col("_last"))
    return (d.join(last, F.col("_s").eqNullSafe(F.col("_ls")), "left")
            .withColumn(out, F.when(train, F.lit(TRAIN)).otherwise(F.lit(VALIDATION)))
            .drop("_h", "_b", "_s", "_ls", "_last"))


def split_holdout(df: DataFrame, key: str, frac: float = 0.9, seed: int = 42, out: str = "split") -> DataFrame:
    """``train`` for the first ``floor(frac * n)`` rows in hash order, else ``validation``.
    ``key`` should identify a row."""
    return _split(df, key, frac, seed, [], out)


def split_stratified(df: DataFrame, key: str, label: str, frac: float = 0.8, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Per label, ``train`` for the first ``floor(frac * n_label)`` rows in hash order."""
    return _split(df, key, frac, seed, [label], out)
