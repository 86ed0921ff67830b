"""Explanation scoring: pair TF-IDF cosine (A14), synonym expansion (X4),
keyword coverage (A12)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .broadcast import maybe_broadcast

# idf of a token seen in only one of the two texts: ln((1+2)/(1+1)) + 1
IDF_ONE_SIDE = math.log(1.5) + 1.0


def tfidf_pair_cosine(df: DataFrame, keys: Sequence[str], text_a: str, text_b: str,
                      out: str = "cosine_similarity") -> DataFrame:
    """Cosine of the TF-IDF vectors of two texts, the vectoriser fitted on just the pair.

    raw term counts, smooth idf over the two texts (1 when a token is in both,
    ln 1.5 + 1 otherwise), L2 norm. One text without tokens gives 0, both give null.

    Plan: one row per (pair, token) after a partially aggregated shuffle, then a
    per-pair reduction; no pair-by-pair loop, no texts x vocabulary product.
    """
    keys = list(keys)
    side = F.explode(F.concat(
        F.transform(tokens(text_a), lambda t: F.struct(t.alias("tok"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
        F.transform(tokens(text_b), lambda t: F.struct(t.alias("tok"), F.lit(0).alias("a"), F.lit(1).alias("b"))),
        # one empty entry keeps pairs without any token in the result
        F.array(F.struct(F.lit(None).cast("string").alias("tok"), F.lit(0).alias("a"), F.lit(0).alias("b"))),
    )).alias("t")
    tf = (df.select(*keys, side)
            .groupBy(*keys, F.col("t.tok").alias("tok"))
            .agg(F.sum("t.a").cast("double").alias("ta"), F.sum("t.b").cast("double").alias("tb")))
    idf = F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.lit(1.0)).otherwise(F.lit(IDF_ONE_SIDE))
    wa, wb = F.col("ta") * idf, F.col("tb") * idf
    agg = tf.groupBy(*keys).agg(
        F.sum(wa * wb).alias("_dot"), F.sum(wa * wa).alias("_na"), F.sum(wb * wb).alias("_nb"))
    cos = (F.when((F.col("_na") == 0) & (F.col("_nb") == 0), F.lit(None).cast("double"))
            .when((F.col("_na") == 0) | (F.col("_nb") == 0), F.lit(0.0))
            .otherwise(F.col("_dot") / (F.sqrt(F.col("_na")) * F.sqrt(F.col("_nb")))))
    return agg.select(*keys, cos.alias(out))


def synonym_expand(features: DataFrame, feature: str, synonyms: DataFrame,
                   word: str = "word", synonym: str = "synonym",
                   include_self: bool = False, out: str = "synonyms") -> DataFrame:
    """Attach the lower-cased synonym set of each feature (sorted, distinct).

    A feature without an entry falls back to ``[lower(feature)]``. The lookup is a
    join on the *distinct* feature words (the memoised lookup of the original),
    broadcast only when the synonym table is small enough.
    """
    words = features.select(F.col(feature).alias("_w")).distinct()
    syn = synonyms.select(F.lower(F.col(word)).alias("_lw"), F.lower(F.col(synonym)).alias("_s"))
    lut = (words.join(maybe_broadcast(syn), F.lower(F.col("_w")) == F.col("_lw"), "left")
                .groupBy("_w").agg(F.array_sort(F.collect_set("_s")).alias("_syns")))
    syns = F.when(F.size("_syns") > 0, F.col("_syns")).otherwise(F.array(F.lower(F.col("_w"))))
    if include_self:
        syns = F.array_sort(F.array_distinct(F.concat(syns, F.array(F.lower(F.col("_w"))))))
    lut = lut.select("_w", syns.alias(out))
    return features.join(maybe_broadcast(lut, lut_rows_hint=True), F.col(feature) == F.col("_w"), "left").drop("_w")


def keyword_coverage(df: DataFrame, features_with_synonyms: str, text: str,
                     n_features: str | None = None, whole_word: bool = False,
                     prefix: str = "") -> DataFrame:
    """Row-local keyword coverage of a text.

    ``features_with_synonyms``: ``array<struct<feature, synonyms array<string>>>``.
    A feature counts once when any synonym occurs in the lower-cased text
    (substring match by default, ``whole_word=True`` for token match).
    accuracy = matched / number of features, 0 when there are none.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    if whole_word:
        toks = tokens(F.col(text))
        hit = lambda s: F.array_contains(toks, s)
    else:
        hit = lambda s: F.instr(low, s) > 0
    fs = F.col(features_with_synonyms)
    matched = F.size(F.filter(fs, lambda e: F.exists(e["synonyms"], hit))).cast("bigint")
    n = F.size(fs) if n_features is None else F.col(n_features)
    acc = F.when(n > 0, matched / n).otherwise(F.lit(0.0))
    return df.withColumn(prefix + "matched_keyword_count", matched).withColumn(prefix + "keyword_accuracy", acc)


def features_with_synonyms(df: DataFrame, features: str, synonyms: DataFrame, keys: Sequence[str],
                           word: str = "word", synonym: str = "synonym", include_self: bool = False,
                           out: str = "features_with_synonyms") -> DataFrame:
    """Attach ``array<struct<feature, synonyms>>`` for an ``array<string>`` of features.

    The features are exploded, joined with the lookup of their distinct names and put back
    together per ``keys``, which must identify a row. Rows without features get an empty array;
    a feature without an entry falls back to its own lower-cased name.
    """
    ex = df.select(*keys, F.posexplode_outer(F.col(features)).alias("_p", "_f"))
    lut = synonym_expand(ex.select("_f").filter(F.col("_f").isNotNull()).distinct(), "_f", synonyms, word, synonym,
                         include_self=include_self, out="_s")
    entry = F.struct("_p", F.struct(F.col("_f").alias("feature"), F.col("_s").alias("synonyms")).alias("e"))
    j = ex.join(lut, "_f", "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_f").isNotNull(), entry))).alias("_l"))
    j = j.select(*keys, F.transform("_l", lambda x: x["e"]).alias(out))
    return df.join(j, list(keys), "left")
