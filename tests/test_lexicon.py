"""Sentiment lexicon: log-odds, the fixed point of the spread, accuracy on held-out labels."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators.lexicon import best_cut, learn_lexicon, neighbours, score_texts, spread, word_odds


def test_spread_against_a_dense_solve(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    texts = [(" ".join(rng.choices(words, k=rng.randrange(0, 12))),) for _ in range(60)] + [(None,), ("alone",)]
    edges = neighbours(spark.createDataFrame(texts, "text string"), "text")
    count = Counter()
    for (t,) in texts:
        w = (t or "").split()
        for a, b in zip(w, w[1:]):
            count[a, b] += 1
            count[b, a] += 1
    # a word beside itself is counted from both sides
    assert {(r.word, r.other): r.n for r in edges.collect()} == dict(count)
    seeds = {"w1": 0.9, "w2": -0.7, "unseen": 1.0}
    known = sorted({a for a, _ in count})
    P = np.array([[count[a, b] for b in known] for a in known], float)
    P /= P.sum(1, keepdims=True)
    seed = np.array([seeds.get(a, 0.0) for a in known])
    for share in (0.0, 0.3, 0.8):
        want = np.linalg.solve(np.eye(len(known)) - share * P, (1 - share) * seed)
        got = {r.word: r.score for r in spread(spark.createDataFrame(list(seeds.items()), "word string, seed double"), edges, share, 1e-4).collect()}
        assert sorted(got) == known and max(abs(got[a] - x) for a, x in zip(known, want)) < 1e-4


def test_word_odds(spark):
    rows = [("bad bad word", 1), ("bad Other", 1), ("good word", 0), ("other", 0), (None, 1), ("none", None), ("odd", 7)]
    got = {r.word: r for r in word_odds(spark.createDataFrame(rows, "t string, y int"), "t", "y", prior=10.0).collect()}
    assert {w: (r.n1, r.n0) for w, r in got.items()} == {"bad": (2, 0), "word": (1, 1), "other": (1, 1), "good": (0, 1)}
    a = 10 * 2 / 7
    odds = math.log((2 + a) / (4 + 10 - 2 - a)) - math.log((0 + a) / (3 + 10 - 0 - a))
    assert got["bad"].odds == pytest.approx(odds) and got["bad"].z == pytest.approx(odds / math.sqrt(1 / (2 + a) + 1 / a))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = docs.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    train, held = known.filter("doc_id % 3 <> 0"), known.filter("doc_id % 3 = 0")
    lexicon = learn_lexicon(train, docs, "text", "toxic")
    cut = best_cut(score_texts(train, ["doc_id", "toxic"], "text", lexicon), "toxic")
    scored = score_texts(held, ["doc_id", "toxic"], "text", lexicon)
    r = scored.agg(F.avg(((F.col("score") < cut).cast("int") == F.col("toxic")).cast("int")).alias("right"), F.avg(1 - F.col("toxic")).alias("most")).first()
    assert r.right > r.most + 0.03, r


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, y int")
    assert learn_lexicon(none, none, "text", "y").count() == 0
    assert best_cut(spark.createDataFrame([], "score double, y int"), "y") < -1


def test_words_by_hash_or_by_themselves(spark, monkeypatch):
    """Scores are the same either way, and equal hashes are noticed; texts are split once."""
    from surveyspark.operators import lexicon

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["bad", "worse"] if k % 3 == 0 else ["fine", "nice"], k=3) + rng.choices(["and", "the", "of", "to"], k=8)), int(k % 3 == 0))
            for k in range(300)] + [(300, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    calls, split = [], lexicon.tokens
    monkeypatch.setattr(lexicon, "tokens", lambda c: calls.append(c) or split(c))
    by_hash = sorted(tuple(r) for r in lexicon.learnt_sentiment(df.drop("y"), df, ["id"], "text", "y").collect())
    assert len(calls) == 2  # the rows and the labelled rows
    monkeypatch.setattr(lexicon, "_hashed", lambda words: False)
    by_word = sorted(tuple(r) for r in lexicon.learnt_sentiment(df.drop("y"), df, ["id"], "text", "y").collect())
    assert [(a, c) for a, _, c in by_hash] == [(a, c) for a, _, c in by_word] and len({c for *_, c in by_hash}) == 2
    assert max(abs(a[1] - b[1]) for a, b in zip(by_hash, by_word)) < 1e-9
    monkeypatch.undo()
    assert lexicon._hashed(df.select(F.col("text").alias("word")).filter("word is not null"))
    monkeypatch.setattr(lexicon.F, "xxhash64", lambda c: F.length(c))
    assert not lexicon._hashed(spark.createDataFrame([("ab",), ("cd",)], "word string"))
