"""Readers for the provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views of the named tables, read anew: a rewritten file is never seen stale."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
