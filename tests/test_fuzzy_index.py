"""The gram index of the fuzzy match: no pair above the cutoff is lost, few others are scored."""

import random

import pytest
from pyspark.sql import functions as F

from surveyspark.operators.standardize import best_matches, candidates, ratio_score


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + rng.choice("abcdü ") + text[at:], text[:at] + text[at + 1:],
                           text[:at] + rng.choice("xyz") + text[at + 1:]])
    return text


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeüi") for _ in range(rng.randrange(1, 8))) for _ in range(25)]
    terms = ["", "a", "ab", "aaaaaaaa", *(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(90))]
    values = [edited(rng, rng.choice(terms), rng.randrange(7)) for _ in range(160)] + ["aaaaaa", "aaaaaaaaaa", "b", ""]
    return sorted(set(values)), list(dict.fromkeys(terms))


@pytest.mark.parametrize("cutoff", [100.0, 90.0, 70.0, 55.0, 30.0])
def test_exact_against_all_pairs(spark, cutoff):
    values, terms = texts(int(cutoff))
    v = spark.createDataFrame([(x,) for x in values], "_low string")
    t = spark.createDataFrame([(x, k) for k, x in enumerate(terms)], "term string, pos int")
    score = ratio_score(F.col("_low"), F.col("term"))
    every = v.crossJoin(t).withColumn("s", score).filter(F.col("s") >= cutoff).collect()
    for size in (1 << 14, 30):  # one block of terms, several
        met = [(r["_low"], r["term"]) for r in candidates(v, t, cutoff, size).collect()]
        assert len(met) == len(set(met)) and {(r["_low"], r["term"]) for r in every} <= set(met)
    want = {}
    for r in sorted(every, key=lambda r: (-r.s, r.pos)):
        want.setdefault(r["_low"], r["term"])
    assert {r["_low"]: r["_best"] for r in best_matches(v, t, cutoff).collect()} == want
    assert len(want) > 10


def test_few_pairs_are_scored(spark):
    """10,000 texts of 45 characters against 10,000: each is an edited term of the other side."""
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "ei")]
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.choice([2, 3, 4]))) for _ in range(9))[:45].strip()
    terms = list({text() for _ in range(10_000)})
    values = list({edited(rng, x, 5) for x in terms})
    v = spark.createDataFrame([(x,) for x in values], "_low string").repartition(8)
    t = spark.createDataFrame([(x, k) for k, x in enumerate(terms)], "term string, pos int").repartition(8)
    met = candidates(v, t, 70.0)
    scored = met.count()
    assert scored < 0.01 * len(values) * len(terms)
    found = met.filter(ratio_score(F.col("_low"), F.col("term"), 70.0) >= 70.0).select("_low").distinct().count()
    assert found >= 0.99 * len(values)
    print(scored / len(values) / len(terms))
