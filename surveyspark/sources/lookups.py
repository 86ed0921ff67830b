"""Readers for the small lookup files of the pipeline (S9): a JSON list of
category terms, a JSON object mapping column names to readable names, and the
prompt template configuration table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of strings -> ``(pos, term)``; duplicates are kept (the first
    position wins where a dictionary needs distinct terms)."""
    return _whole(spark, path).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "term")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def write_term_lines(terms: DataFrame, path: str) -> None:
    """``(pos, term)`` as one JSON object per line: a list of any length, written by many tasks."""
    terms.select(F.to_json(F.struct("pos", "term")).alias("value")).write.text(path)


def read_term_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_term_lines`` wrote -> ``(pos, term)``, read line by line."""
    return spark.read.schema("pos bigint, term string").json(path)


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object -> ``(pos, name, renamed)`` in file order."""
    m = F.from_json("value", "map<string,string>")
    return _whole(spark, path).select(F.posexplode(m).alias("pos", "name", "renamed")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def name_map(df: DataFrame) -> dict[str, str]:
    """The rename table as a dict for ``rename_by_dictionary`` (a column list: metadata-sized)."""
    return {r["name"]: r["renamed"] for r in df.orderBy("pos").collect()}


def read_template_config(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``group_pos, group, field_pos, pattern, template`` (header, quoted) -> config table
    for ``config_from_table``."""
    schema = "group_pos int, group string, field_pos int, pattern string, template string"
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)
