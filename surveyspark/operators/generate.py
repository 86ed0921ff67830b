"""Explanation requests and batched generation: head per group (W2), request
building (T4), generation with a caller-supplied function (M6), prompt strip (F12)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_prompt
from ..session import cut_lineage

# The messages of an explanation request.
SYSTEM_MESSAGE = ("You are a helpful assistant that explains how different features influence "
                  "a model's prediction based on SHAP values.")
USER_HEAD = "Here are the most important features for an example:\n\n"
USER_TAIL = "\n\nPlease explain in simple terms how these features affect the prediction."


def head_per_group(df: DataFrame, group: Sequence[str] | str, order: Sequence[str] | str, n: int) -> DataFrame:
    """First ``n`` rows of every group in ``order``.

    ``row_number() <= n`` lets Catalyst insert a per-group limit before the shuffle
    (WindowGroupLimit), so a hot group ships at most ``n`` rows per map task.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def user_message(shap_text: Column) -> Column:
    return F.concat(F.lit(USER_HEAD), shap_text, F.lit(USER_TAIL))


def explanation_request(df: DataFrame, shap_text: str = "shap_text", style: str = "chat",
                        out: str = "request") -> DataFrame:
    """``chat``: ``array<struct<role, content>>`` (system, user); ``plain``: the two
    messages joined by a newline."""
    if style == "chat":
        req = F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                      F.struct(F.lit("user").alias("role"), user_message(F.col(shap_text)).alias("content")))
    elif style == "plain":
        req = F.concat(F.lit(SYSTEM_MESSAGE + "\n"), user_message(F.col(shap_text)))
    else:
        raise ValueError(style)
    return df.withColumn(out, req)


def batch_generate(df: DataFrame, fn: Callable[[pd.Series], pd.Series], prompt: str = "request",
                   out: str = "llm_text", echo: bool = True) -> DataFrame:
    """Run ``fn`` (a batch of prompt texts -> generated texts) over Arrow batches in
    every partition; with ``echo`` the echoed prompt is removed from the output.

    ``fn`` is the caller's model client; it runs where the data is, in parallel
    per partition. A model need not answer twice alike, so the answers are stored once
    (shared checkpoint folder) and everything later reads the stored ones.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out + "_raw", T.StringType())])

    def run(batches):
        for pdf in batches:
            pdf[out + "_raw"] = fn(pdf[prompt].astype(str)).astype(object).values if len(pdf) else []
            yield pdf

    g = cut_lineage(df.mapInPandas(run, schema))
    text = strip_prompt(F.col(out + "_raw"), F.col(prompt)) if echo else F.col(out + "_raw")
    return g.withColumn(out, text).drop(out + "_raw")
