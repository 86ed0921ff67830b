"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes the documents that the one before kept and returns documents (the last one:
token ids). ``run`` writes each stage as Parquet in the shared checkpoint folder and rereads it.

Edge cases: a null, empty or letterless text goes at the first stage, a corpus without labels loses
no other; of rows that are equal in id and text one stays; rows that repeat an id with another text
are documents of their own; a null doc_id is never a near duplicate and stays; of tied near
duplicates the smallest id stays, and its smallest text hash; very long texts are handled whole; an
empty table gives an empty result; columns other than the five of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import bpe, decontam, lang_id, ngram_join, substring_dedup
from surveyspark.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and texts without a letter in a script of any trained language.
    Without a label in the corpus there is no model, and every text with letters stays."""
    model = lang_id.fit(docs.where(~lang_id.held_out(F.col("doc_id"))))
    found = lang_id.identify(docs.select(*COLUMNS), model, spans=False)
    if model.langs:
        return found.where((F.col("lang_pred") != lang_id.UND) & (F.col("score") > 0)).select(*COLUMNS)
    return found.where(F.rlike("text", F.lit(r"\p{L}"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every component of near duplicates: of the smallest id, and of the texts
    that this id has in the component the one of smallest hash."""
    docs = docs.select(*COLUMNS)
    kept = ngram_join.similar(docs, with_first=True).where("first and doc_id is not null").select("doc_id", "said").distinct()
    alone = docs.where("doc_id is null")
    one = docs.withColumn("said", F.xxhash64("text")).join(kept, ["doc_id", "said"], "left_semi").dropDuplicates(["doc_id", "said"])
    return one.unionByName(alone, allowMissingColumns=True).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows out of the texts; a document of which nothing is left goes."""
    cut = substring_dedup.remove_repeats(docs, carry=("lang", "source")).where("n_removed < n_words or n_words = 0")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontam.find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode_texts(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

ORACLE_SQL = None  # no stage but the filters can be said in SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
