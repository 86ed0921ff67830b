"""Sentiment labels of free text (M5), re-aimed from a pretrained classifier to
(a) a lexicon score and (b) a Spark ML text classifier trained on labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, tokens
from ..session import cut_lineage
from .broadcast import stored_side


def sentiment_lexicon(df: DataFrame, text: str, lexicon: DataFrame, keys: Sequence[str], word: str = "word",
                      score: str = "score", out: str = "sentiment") -> DataFrame:
    """``positive`` / ``negative`` / ``neutral`` from the summed lexicon scores of the
    text's tokens (missing text counts as empty). ``keys`` identify a row.

    The tokens of a row are counted first (map-side), then joined with the lexicon: by
    broadcast after a check of its size, else by sort and merge with hot words split.
    """
    lex = lexicon.groupBy(F.lower(F.col(word)).alias("_w")).agg(F.sum(score).cast("double").alias("_x"))
    toks = df.select(*keys, F.explode(tokens(F.col(text))).alias("_w")).groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n"))
    total = toks.join(stored_side(lex), "_w").groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_n")).alias("_total"))
    scored = df.join(total, list(keys), "left").withColumn(out + "_score", F.coalesce("_total", F.lit(0.0))).drop("_total")
    s = F.col(out + "_score")
    return scored.withColumn(out, F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral"))


def fit_sentiment(train: DataFrame, text: str, label: str, num_features: int = 1 << 18, seed: int = 42):
    """Spark ML pipeline: tokens -> hashed term counts -> IDF -> logistic regression.

    The training texts are tokenized and hashed once into the shared checkpoint
    folder (sparse term counts, far smaller than the texts); the IDF fit and
    every regression pass read that instead of tokenizing again. The result is
    the same four-stage ``PipelineModel``.
    """
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    data = train.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"))
    counts = cut_lineage(tf.transform(tok.transform(data)).select("_tf", "_label"))
    idf = IDF(inputCol="_tf", outputCol="_features").fit(counts)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=50, regParam=0.01).fit(
        idf.transform(counts))
    return PipelineModel(stages=[tok, tf, idf, lr])


def sentiment_trained(df: DataFrame, text: str, model, labels: dict[int, str] | None = None,
                      out: str = "sentiment") -> DataFrame:
    """Apply a fitted pipeline; the predicted class is mapped through ``labels``."""
    labels = labels or {0: "neutral", 1: "negative"}
    d = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    p = model.transform(d)
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(float(k)), F.lit(v))])
    return p.withColumn(out, F.try_element_at(m, F.col("prediction"))).drop(
        "_text", "_tok", "_tf", "_features", "rawPrediction", "probability", "prediction")
