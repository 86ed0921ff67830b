"""Helpers shared by the query bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# SQL fragment of the token pattern used by the oracle queries (same as TOKEN_PATTERN)
SQL_TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def r6(c) -> Column:
    """Round a double result to 6 places (the oracle rounds the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it: ``(conv_id, turn, text_a, text_b)``.

    An equi-join on ``(conv_id, turn)``: the keys are unique, so a long
    conversation does not become one hot task.
    """
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text_a"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    return u.join(a, ["conv_id", "turn"])


SQL_PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS text_a, a.text AS text_b
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def sql_pair_cosine(pairs: str, keys: str, a: str = "text_a", b: str = "text_b") -> str:
    """CTE chain computing ``cos`` per pair key from CTE ``pairs`` (same algebra as Spark)."""
    ta = SQL_TOKENS.format(x=a)
    tb = SQL_TOKENS.format(x=b)
    return f"""toks AS (
  SELECT {keys}, unnest({ta}) AS tok, 1 AS a, 0 AS b FROM {pairs}
  UNION ALL
  SELECT {keys}, unnest({tb}) AS tok, 0 AS a, 1 AS b FROM {pairs}),
tf AS (SELECT {keys}, tok, sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM toks GROUP BY {keys}, tok),
tw AS (SELECT {keys}, ta * CASE WHEN ta > 0 AND tb > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS wa,
              tb * CASE WHEN ta > 0 AND tb > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS wb FROM tf),
cagg AS (SELECT {keys}, sum(wa * wb) AS dot, sum(wa * wa) AS na, sum(wb * wb) AS nb FROM tw GROUP BY {keys}),
cos AS (
  SELECT p.*, CASE WHEN coalesce(na, 0) = 0 AND coalesce(nb, 0) = 0 THEN NULL
                   WHEN coalesce(na, 0) = 0 OR coalesce(nb, 0) = 0 THEN 0.0
                   ELSE dot / (sqrt(na) * sqrt(nb)) END AS cosine_similarity
  FROM {pairs} p LEFT JOIN cagg USING ({keys}))"""
