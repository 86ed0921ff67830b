"""Many keywords at once (A12, X8): one pass over a text for all of them.

The keywords make an automaton (Aho-Corasick) that follows a text character by character and reports
every keyword that ends there, so the cost of a text does not grow with the number of keywords. A
keyword table of bounded size is one automaton in every task and the texts are not shuffled; a
larger one is cut into blocks, and a text meets every block in some task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .broadcast import stored

BLOCK_KEYWORDS = 1 << 17  # keywords of one automaton


class Automaton:
    """Finds which of the keywords (not empty) occur in a text."""

    def __init__(self, keywords: Sequence[str]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for k in keywords:
            self.tree.add_word(k, k)
        if len(self.tree):
            self.tree.make_automaton()

    def found(self, text: str) -> list[str]:
        return sorted({k for _, k in self.tree.iter(text)}) if len(self.tree) else []


def find_keywords(df: DataFrame, keys: Sequence[str], text: str, keywords: DataFrame, keyword: str = "keyword",
                  block_keywords: int = BLOCK_KEYWORDS) -> DataFrame:
    """``(keys..., keyword)``: every distinct keyword that is a substring of a row's lower-cased text, once
    per row. Null and empty keywords occur nowhere, a null text holds nothing."""
    keys = list(keys)
    words = keywords.select(F.col(keyword).alias("keyword")).filter(F.length("keyword") > 0).distinct()
    words, small = stored(words)
    rows = df.select(*keys, F.lower(F.col(text)).alias("_text")).filter(F.col("_text").isNotNull())
    schema = rows.select(*keys, F.lit("").alias("keyword")).schema

    def hits(batch: pa.Table | pa.RecordBatch, tree: Automaton) -> pa.Table:
        found = [tree.found(t) for t in batch.column("_text").to_pylist()]
        row = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
        return pa.table({**{c: batch.column(c).take(row) for c in keys}, "keyword": pa.array([x for f in found for x in f], pa.string())})

    n = words.count()
    if small and n <= block_keywords:
        every = [r.keyword for r in words.collect()]  # bounded: the check above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Automaton(every)
            for batch in batches:
                yield from hits(batch, tree).to_batches()

        return rows.mapInArrow(run, schema)

    blocks, shares = -(-n // block_keywords), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every_one = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("_block", every_one(blocks)).withColumn("_share", F.pmod(F.xxhash64(*keys, "_text"), F.lit(shares)).cast("int"))
    right = words.select("keyword", F.pmod(F.xxhash64("keyword"), F.lit(blocks)).cast("int").alias("_at"), every_one(shares).alias("_in"))

    def meet(texts: pa.Table, words: pa.Table) -> pa.Table:
        tree = Automaton(words.column("keyword").to_pylist()) if texts.num_rows else Automaton(())
        return hits(texts.combine_chunks(), tree)

    return left.groupBy("_block", "_share").cogroup(right.groupBy("_at", "_in")).applyInArrow(meet, schema)


def coverage(df: DataFrame, keys: Sequence[str], features_with_synonyms: str, text: str) -> DataFrame:
    """``(keys..., matched_keyword_count, keyword_accuracy)``: how many of a row's features have a synonym
    in its text (as ``score.keyword_coverage``), all rows' synonyms looked for at once. ``keys`` identify
    a row; a row without features has accuracy 0."""
    keys = list(keys)
    listed = df.select(*keys, F.posexplode_outer(features_with_synonyms).alias("_at", "_f"))
    sized = listed.groupBy(*keys).agg(F.count("_at").alias("_n"))
    own = listed.select(*keys, "_at", F.explode("_f.synonyms").alias("keyword"))
    met = own.join(find_keywords(df, keys, text, own), [*keys, "keyword"], "left_semi")
    matched = met.groupBy(*keys).agg(F.count_distinct("_at").alias("_m"))
    m = F.coalesce("_m", F.lit(0)).cast("bigint")
    return sized.join(matched, keys, "left").select(*keys, m.alias("matched_keyword_count"),
                                                    F.when(F.col("_n") > 0, m / F.col("_n")).otherwise(0.0).alias("keyword_accuracy"))
