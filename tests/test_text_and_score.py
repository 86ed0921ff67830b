import math
import random

import pytest
from pyspark.sql import functions as F

from surveyspark.functions.text import (format_fixed, safe_name, sheet_name, strip_prompt, strip_ws, token_budget,
                                        tokens)
from surveyspark.operators.score import features_with_synonyms, keyword_coverage, tfidf_pair_cosine
from tests.conftest import SF01


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_tokens_unicode(spark):
    got = one(spark, tokens(F.col("x")), "Übermäßig gut: été_2 a b1 x; Kündigung's naïve ﬁne")
    assert got == ["übermäßig", "gut", "été_2", "b1", "kündigung", "naïve", "ﬁne"]


def test_strip_and_names(spark):
    assert one(spark, strip_ws(F.col("x")), " \t a b \n") == "a b"
    assert one(spark, safe_name(F.col("x")), "gpt-4o mini/ft:x") == "gpt-4o_mini_ft_x"
    df = spark.createDataFrame([(9, "a/b?c"), (10, "x" * 40), (1000, "q")], "n int, t string")
    got = [r[0] for r in df.select(sheet_name(F.col("n"), F.col("t"))).collect()]
    assert got == ["009 a_b_c", "010 " + "x" * 27, "1000 q"]


def test_format_fixed_matches_python(spark):
    random.seed(3)
    xs = [0.125, 2.675, 1.005, -2.675, 0.375, -0.001, 0.0, 1e-20, 123.455, 0.005, 0.015, -0.125]
    xs += [round(random.uniform(-50, 50), 3) for _ in range(2000)] + [k / 8 for k in range(-200, 200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(format_fixed("x", 2)).collect()]
    assert got == ["%.2f" % x for x in xs]


def test_strip_prompt_and_budget(spark):
    df = spark.createDataFrame([("Hello", "Hello  answer \n")], "p string, o string")
    assert df.select(strip_prompt(F.col("o"), F.col("p"))).first()[0] == "answer"
    b = one(spark, token_budget(F.col("x"), 3), "  a b  c d e ")
    assert (b["n_tokens"], b["kept_text"], b["n_pad"], b["truncated"]) == (5, "a b c", 0, True)
    b = one(spark, token_budget(F.col("x"), 3), "   ")
    assert (b["n_tokens"], b["n_pad"], b["truncated"]) == (0, 3, False)


def _cos(spark, rows):
    df = spark.createDataFrame(rows, "k int, a string, b string")
    return {r["k"]: r["cosine_similarity"] for r in tfidf_pair_cosine(df, ["k"], "a", "b").collect()}


def test_pair_cosine_golden_and_properties(spark):
    c = _cos(spark, [(1, "gut gut teuer", "gut billig"), (2, "gut billig", "gut gut teuer"),
                     (3, "Same words here", "same WORDS here"), (4, "", "something"), (5, "", "a"),
                     (6, "x y", "Different text")])
    assert round(c[1], 6) == 0.474331
    assert c[1] == pytest.approx(c[2])
    assert c[3] == pytest.approx(1.0)
    assert c[4] == 0.0
    assert c[5] is None  # no token of two characters on either side
    assert c[6] == 0.0


def test_pair_cosine_mean_on_conversations(spark):
    from surveyspark.plans.common import conversation_pairs
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    c = tfidf_pair_cosine(conversation_pairs(conv), ["conv_id", "turn"], "text_a", "text_b")
    r = c.agg(F.count("*").alias("n"), F.avg("cosine_similarity").alias("m")).first()
    assert r["n"] == 233
    assert round(r["m"], 6) == 0.193616


def test_keyword_coverage(spark):
    df = spark.createDataFrame([(1, ["l quantity", "tax", "Price"], "The QUANTITY and the price"),
                                (2, [], "anything"), (3, ["tax"], None)],
                               "k int, feats array<string>, text string")
    syn = spark.createDataFrame([("l quantity", "Quantity"), ("price", "preis")], "word string, synonym string")
    d = features_with_synonyms(df, "feats", syn, ["k"])
    got = {r["k"]: (r["matched_keyword_count"], r["keyword_accuracy"])
           for r in keyword_coverage(d, "features_with_synonyms", "text").collect()}
    # 'tax' falls back to itself (absent); 'Price' only has 'preis' (the word itself is not a synonym)
    assert got[1] == (1, pytest.approx(1 / 3))
    assert got[2] == (0, 0.0)
    assert got[3] == (0, 0.0)
    fs = {r["k"]: r["features_with_synonyms"] for r in d.collect()}
    assert [(e["feature"], e["synonyms"]) for e in fs[1]] == [
        ("l quantity", ["quantity"]), ("tax", ["tax"]), ("Price", ["preis"])]
    assert not math.isnan(got[1][1])
