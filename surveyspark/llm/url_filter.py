"""URL filter: host rules, and gradient-boosted trees over lexical features for the rest.

DataFrame functions and Spark ML only. The trees learn from labelled URLs (here: those that a
rule decides): a bounded sample of distinct labelled URLs, the ``sample`` smallest by hash.
Suffix statistics (the share of blocked URLs per last label and last two labels of the host)
count all distinct labelled URLs; their table is broadcast only after a check of its size.

Edge cases: null url or none with ``://``: host and path empty, no rule, judged by the trees on
empty features; very long urls are judged whole; repeated rows get the same verdict; when the
labelled sample has no or only one verdict, that verdict (else ``allow``) stands for all; rules
of equal length: the smaller rule string wins; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators.broadcast import small_side
from surveyspark.session import cut_lineage

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SAMPLE = 4000  # labelled URLs the trees are fitted on
TREES, DEPTH = 8, 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERIC = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "params", "rate1", "rate2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    pick = lambda pattern: F.when(at > 0, F.regexp_extract(rest, pattern, 1)).otherwise(F.lit(""))
    return (F.translate(pick(r"^([^/?#]*)"), _UPPER, _LOWER), pick(r"^[^/?#]*([^?#]*)"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null when none does)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    spread = F.aggregate(
        F.array_distinct(F.split(url, "")), F.lit(0.0),
        lambda s, c: s + F.when(c == "", F.lit(0.0)).otherwise(
            ((size - F.length(F.replace(url, c, F.lit("")))) / size)
            * F.log2(size / (size - F.length(F.replace(url, c, F.lit(""))))) ))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    per = lambda n: F.when(size > 0, n / size).otherwise(F.lit(0.0))
    return (urls.withColumn("length", size.cast("double"))
            .withColumn("host_length", F.length("host").cast("double"))
            .withColumn("depth", F.regexp_count("path", F.lit("/[^/]")).cast("double"))
            .withColumn("labels", F.regexp_count("host", F.lit(r"[^.]+")).cast("double"))
            .withColumn("digit_ratio", per(F.length(F.regexp_replace(url, "[^0-9]", "")).cast("double")))
            .withColumn("entropy", F.when(size > 0, spread).otherwise(F.lit(0.0)))
            .withColumn("params", F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"))
            .withColumn("suffix1", F.substring_index("host", ".", -1))
            .withColumn("suffix2", F.substring_index("host", ".", -2)))


def suffix_rates(labelled: DataFrame) -> dict[str, DataFrame]:
    """Per suffix of one or two labels the share of blocked URLs among the distinct ``labelled`` ones."""
    two = cut_lineage(labelled.groupBy(F.substring_index("host", ".", -2).alias("suffix2")).agg(
        F.sum("label").alias("blocked"), F.count("*").alias("n")))
    one = two.groupBy(F.substring_index("suffix2", ".", -1).alias("suffix1")).agg(
        F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    return {k: small_side(cut_lineage(t.select(f"suffix{k}", ((F.col("blocked") + 1) / (F.col("n") + 2)).alias(f"rate{k}"))))
            for k, t in (("1", one), ("2", two))}


def _with_rates(urls: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for k, rate in rates.items():
        urls = urls.join(rate, f"suffix{k}", "left").fillna(0.5, [f"rate{k}"])
    return urls


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
          sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Per row: ``id_col, host, path, rule, verdict, block_score`` (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)

    labelled = rows.where("said is not null").select("url", "host", "path", (F.col("said") == "block").cast("double").alias("label"))
    labelled = labelled.distinct()
    chosen = cut_lineage(with_features(labelled.orderBy(F.xxhash64("url"), "url").limit(sample)))
    verdicts = [r["label"] for r in chosen.select("label").distinct().collect()]  # two rows at most
    known = F.col("said")
    if len(verdicts) < 2:
        usual = "block" if verdicts == [1.0] else "allow"
        judged = rows.withColumn("block_score", F.lit(None).cast("double")).withColumn("verdict", F.coalesce(known, F.lit(usual)))
    else:
        assemble = VectorAssembler(inputCols=list(NUMERIC), outputCol="features")
        rates = suffix_rates(labelled)
        model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=7, checkpointInterval=-1,
                              cacheNodeIds=False).fit(assemble.transform(_with_rates(chosen, rates)).select("features", "label"))
        scored = model.transform(assemble.transform(_with_rates(with_features(rows), rates)))
        score = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
        judged = scored.withColumn("block_score", score).withColumn(
            "verdict", F.coalesce(known, F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", "verdict", "block_score")
