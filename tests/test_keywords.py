"""Many keywords at once: equal to looking for each by itself."""

import random

import pytest
from pyspark.sql import functions as F

from surveyspark.operators.keywords import coverage, find_keywords
from surveyspark.operators.score import keyword_coverage


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_equal_to_instr(spark, block):
    rng = random.Random(1)
    alphabet = "abcäß 語."
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 5))) for _ in range(200)] + ["a", "aa", "aaa", "ÄB", None]
    texts = ["".join(rng.choice(alphabet + "ABÄ") for _ in range(rng.randrange(120))) for _ in range(150)] + [None, "", "aaaa" * 500]
    t = spark.createDataFrame([(k, x, "w") for k, x in enumerate(texts)], "id int, body string, keyword string").repartition(4)
    k = spark.createDataFrame([(x,) for x in words], "keyword string")
    got = [(r.id, r.keyword) for r in find_keywords(t.drop("keyword"), ["id"], "body", k, block_keywords=block).collect()]
    want = t.select("id", "body").join(k.distinct()).filter((F.length("keyword") > 0) & (F.instr(F.lower("body"), F.col("keyword")) > 0))
    assert sorted(got) == sorted((r.id, r.keyword) for r in want.select("id", "keyword").collect())
    assert len(got) > 1000


def test_coverage(spark):
    rows = [(1, "The Cheap price", [("a", ["price", "cost"]), ("b", ["dear"]), ("c", ["cheap", "price"])]), (2, None, [("a", ["x"])]),
            (3, "nothing", []), (4, "x", None), (5, "dup", [("a", ["dup"]), ("a", ["dup", "up"])])]
    df = spark.createDataFrame(rows, "id int, text string, f array<struct<feature:string,synonyms:array<string>>>")
    got = sorted(tuple(r) for r in coverage(df, ["id"], "f", "text").collect())
    assert got == [(1, 2, 2 / 3), (2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0), (5, 2, 1.0)]
    plain = keyword_coverage(df.filter("f is not null"), "f", "text").select("id", "matched_keyword_count", "keyword_accuracy")
    assert {tuple(r) for r in plain.collect()} <= set(got)


def test_no_keywords(spark):
    df = spark.createDataFrame([(1, "text")], "id int, text string")
    assert find_keywords(df, ["id"], "text", spark.createDataFrame([("",), (None,)], "keyword string")).count() == 0
