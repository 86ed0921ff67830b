"""The registered queries of the operators: each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import (
    alignment,
    bpe,
    chat_format,
    decontam,
    embedding_dedup,
    lang_id,
    lm_score,
    ngram_join,
    periodic_runs,
    pii,
    substring_dedup,
    token_counts,
    url_filter,
)
from surveyspark.llm.oracle import ORACLE as ORACLE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read(spark, sf_dir, "documents"), with_ids=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1, 3).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 1, "user").otherwise("assistant").alias("role"),
                                   F.lit(said).alias("text"))
    parts = rows.unionByName(own).withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.digests(chat_format.format_chats(parts))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict_languages(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item found in it."""
    found = decontam.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), short=True)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat token files, then counted from the files alone."""
    blocks = token_counts.write_blocks(read(spark, sf_dir, "documents"))
    return token_counts.count_documents(blocks).select("doc_id", "n_tokens", "finished")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_texts(read(spark, sf_dir, "documents"), with_groups=False)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(read(spark, sf_dir, "documents")))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """The stated input of op13: in every tenth document (by crc32 of the id) the words from word a
    on repeat the p words from there."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))  # size of null: -1 or null
    d = d.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse_runs(with_periodic_ends(read(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_lm_score": op9_lm_score,
    "op10_url_filter": op10_url_filter,
    "op11_token_alignment": op11_token_alignment,
    "op12_pii": op12_pii,
    "op13_periodic_runs": op13_periodic_runs,
}
