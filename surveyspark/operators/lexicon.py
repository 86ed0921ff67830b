"""Sentiment lexicon learnt from labelled and unlabelled texts (M5).

Words that labelled texts tell apart are seeds: their log-odds between the two classes, with a prior
that pulls rare words towards the corpus, are many standard deviations from zero. Seeds spread over
the graph of neighbouring words of all texts: a word's score is a share of its seed value plus the
rest of the weighted mean of its neighbours' scores. The share makes this a contraction, so the
scores settle at one fixed point, by a factor per round.

Everything is joins and sums by word; nothing is gathered. Null texts have no words; a label other
than 0 and 1 or null labels nothing; an empty table gives an empty lexicon.

A text is a string, or the array of its words if they are known. ``learnt_sentiment`` splits every text
once and has a word's 64-bit hash for the word, after a look at the vocabulary: only if two of its words
share a hash, the words themselves. The graph is dealt out by neighbour once and kept so; a round moves
scores and sums, not links.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from .broadcast import stored

PRIOR = 1000.0  # words of the prior: as many as if drawn from the whole corpus
LEAST_Z = 3.0  # standard deviations of a seed
SPREAD = 0.3  # weight of the neighbours
TOLERANCE = 1e-3


def _words(df: DataFrame, text: str) -> Column:
    return F.col(text) if isinstance(df.schema[text].dataType, T.ArrayType) else tokens(F.col(text))


def word_odds(labelled: DataFrame, text: str, label: str, prior: float = PRIOR) -> DataFrame:
    """``(word, n1, n0, odds, z)``: the numbers of texts of label 1 and 0 that hold a word (however often:
    one long text proves nothing), its log-odds between them with a prior from both, and how many
    standard deviations these are from 0."""
    one = (F.col("_y") == 1).cast("bigint")
    words = labelled.select(F.col(label).alias("_y"), F.explode(F.array_distinct(_words(labelled, text))).alias("word")).filter(F.col("_y").isin(0, 1))
    n = words.groupBy("word").agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n0"))
    total = n.agg(F.sum("n1").cast("double").alias("all1"), F.sum("n0").cast("double").alias("all0"))
    d = n.join(F.broadcast(total))  # one row
    d = d.withColumn("a", F.lit(prior) * (F.col("n1") + F.col("n0")) / (F.col("all1") + F.col("all0")))
    side = lambda k: F.log((F.col(f"n{k}") + F.col("a")) / (F.col(f"all{k}") + prior - F.col(f"n{k}") - F.col("a")))
    d = d.withColumn("odds", side(1) - side(0))
    return d.select("word", "n1", "n0", "odds", (F.col("odds") / F.sqrt(1 / (F.col("n1") + F.col("a")) + 1 / (F.col("n0") + F.col("a")))).alias("z"))


def neighbours(texts: DataFrame, text: str) -> DataFrame:
    """``(word, other, n)``: how often two words stand side by side, in either order."""
    w = texts.select(_words(texts, text).alias("_w")).filter(F.size("_w") > 1)
    pair = F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = w.select(F.inline(pair)).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = F.col("a") == F.col("b")  # a word beside itself counts from both sides
    sides = F.when(same, F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), (2 * F.col("n")).alias("n")))).otherwise(
        F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), "n"), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), "n")))
    return pairs.agg(F.count(F.lit(1)).alias("n")).select(F.inline(sides))


def spread(seeds: DataFrame, edges: DataFrame, share: float = SPREAD, tolerance: float = TOLERANCE) -> DataFrame:
    """``(word, score)`` of every word of the graph, within ``tolerance`` of the fixed point of score =
    (1 - share) * seed + share * mean of the neighbours' scores. ``seeds``: ``(word, seed)`` in [-1, 1]."""
    if not 0 <= share < 1:
        raise ValueError("the neighbours' weight is at least 0 and below 1")
    # links stay where their neighbour is: a round deals out scores to them, and adds up before it sends sums on
    at = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = edges.select("other", "word", "n").repartition(at, "other").persist(StorageLevel.DISK_ONLY)
    of_word = links.groupBy("word").agg(F.sum("n").alias("_all"))
    start, _ = stored(of_word.join(seeds, "word", "left").select("word", "_all", F.coalesce("seed", F.lit(0.0)).alias("seed")))
    now = start.select("word", F.col("seed").alias("score"))
    rounds = 0 if share == 0 else math.ceil(math.log(tolerance / 2) / math.log(share))
    for _ in range(rounds):
        there = now.filter("score != 0").select(F.col("word").alias("other"), "score")  # others add nothing
        add = links.join(there.hint("shuffle_hash"), "other").groupBy("word").agg(F.sum(F.col("n") * F.col("score")).alias("_m"))
        now, _small = stored(start.join(add, "word", "left").select("word", (
            F.lit(1 - share) * F.col("seed") + F.lit(share) * F.coalesce(F.col("_m") / F.col("_all"), F.lit(0.0))).alias("score")))
    links.unpersist()
    return now


def learn_lexicon(labelled: DataFrame, texts: DataFrame, text: str, label: str, least_z: float = LEAST_Z,
                  share: float = SPREAD) -> DataFrame:
    """``(word, score)``: below 0 for words that go with label 1, above 0 for those that go with label 0."""
    odds = word_odds(labelled, text, label)
    seeds = odds.filter(F.abs("z") >= least_z).select("word", (-F.tanh(F.col("odds") / 2)).alias("seed"))
    return spread(seeds, neighbours(texts, text), share)


def score_texts(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """``(keys..., score)``: the lowest score of any of the text's words, so a single strong word tells also
    in a long text; 0 for a text without words of the lexicon."""
    lex, small = stored(lexicon.select("word", "score"))
    words = df.select(*keys, F.explode(F.array_distinct(_words(df, text))).alias("word"))
    found = words.join(F.broadcast(lex) if small else lex.hint("shuffle_hash"), "word")
    low = found.groupBy(*keys).agg(F.min("score").alias("_low"))
    return df.select(*keys).join(low, keys, "left").select(*keys, F.coalesce("_low", F.lit(0.0)).alias("score"))


def best_cut(scored: DataFrame, label: str, score: str = "score") -> float:
    """The score below which label 1 is said with the fewest errors on these rows (in steps of a hundredth)."""
    step = scored.filter(F.col(label).isin(0, 1)).groupBy(F.floor(F.col(score) * 100).alias("k")).agg(
        F.sum(F.col(label)).alias("y"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("k")  # at most 200 rows
    gain = F.sum(2 * F.col("y") - F.col("n")).over(upto)
    best = step.select("k", gain.alias("g")).agg(F.max(F.struct("g", (-F.col("k")).alias("k"))).alias("b")).first()["b"]
    return -1.01 if best is None or best["g"] <= 0 else (1 - best["k"]) / 100


def _hashed(words: DataFrame) -> bool:
    """May the hash of a word stand for it? Only if no two ``word`` values share one."""
    return words.distinct().groupBy(F.xxhash64("word").alias("_h")).count().filter("count > 1").isEmpty()


def learnt_sentiment(df: DataFrame, labelled: DataFrame, keys: list[str], text: str, label: str) -> DataFrame:
    """``(keys..., score, sentiment)`` of the rows of ``df``: ``negative`` below the best cut on the labelled
    rows, else ``neutral``. The lexicon is learnt from the labelled rows and the texts of ``df``."""
    split = lambda d, *more: stored(d.select(*keys, *more, tokens(F.col(text)).alias(text)))[0]
    df, labelled = split(df), split(labelled, label)
    if _hashed(df.select(text).unionByName(labelled.select(text)).select(F.explode(text).alias("word"))):
        as_hash = F.transform(text, lambda w: F.xxhash64(w))
        df, labelled = df.withColumn(text, as_hash), labelled.withColumn(text, as_hash)
    lexicon = learn_lexicon(labelled, df, text, label)
    cut = best_cut(score_texts(labelled, [*keys, label], text, lexicon), label)
    scored = score_texts(df, keys, text, lexicon)
    return scored.withColumn("sentiment", F.when(F.col("score") < cut, "negative").otherwise("neutral"))
