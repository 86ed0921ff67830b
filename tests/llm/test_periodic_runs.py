import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import WORD, sha
from pyspark.sql import Row

from surveyspark.llm import periodic_runs as pr
from surveyspark.llm.queries import with_periodic_ends


def plain(words, least_length=6, least_exponent=4):
    """[(start, length, period)] by comparing words that every possible period apart."""
    out, seen = [], set()
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_length, least_exponent * q) and (i, j - i) not in seen:
                if not any(a == i and length == j - i + q for a, length, _ in out):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_with_runs(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(160))]
    for _ in range(rng.randrange(4)):
        p = rng.choice([*range(1, 10), 12, 15, 16, 17, 25, 31])
        unit = [rng.randrange(rng.choice([1, 2, 2, 3, 9])) for _ in range(p)]
        if rng.random() < 0.4:  # a period made of smaller ones
            unit = (unit[:max(1, p // 5)] * 6)[:p]
        many = unit * rng.randrange(2, 9)
        at = rng.randrange(len(words) + 1)
        words[at:at] = many[:len(many) - rng.randrange(p)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_every_period(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [words_with_runs(rng) for _ in range(rng.randrange(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        got = pr.runs(np.array([x for w in texts for x in w], np.int64), first)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(texts) for r in plain(w)]


def test_long_periods_and_other_limits():
    rng = random.Random(5)
    unit = [rng.randrange(4) for _ in range(1500)]
    words = [9] + unit * 4 + unit[:700] + [8] + [1, 2] * 5000
    first = np.array([0, len(words)])
    assert [tuple(r) for r in pr.runs(np.array(words), first).tolist() if r[2] > 5000] == [(0, 1, 6700, 1500), (0, 6702, 10000, 2)]
    few = np.array([1, 2, 3] * 5 + [4] * 7)
    assert pr.runs(few, np.array([0, 22]), least_exponent=6).tolist() == [[0, 15, 7, 1]]
    with pytest.raises(ValueError):
        pr.runs(few, np.array([0, 22]), least_exponent=3)


def test_collapse(spark):
    rng = random.Random(7)
    names = ["a", "b", "über", "d e", "F", "語", *(f"w{k}" for k in range(20))]
    rows = [(k, " \t\n"[k % 3].join(names[x] for x in words_with_runs(rng))) for k in range(80)]
    rows += [(90, None), (91, ""), (92, " \n "), (93, "x " * 20000), (94, "x x x x x"), (None, "y y y y y y"), (3, "z " * 8), (3, "z " * 8)]
    df = spark.createDataFrame([(i, t, 1, "s", "r") for i, t in rows], "doc_id bigint, text string, id int, runs string, n_words string")
    got = pr.collapse_runs(df.repartition(3))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]

    def want(i, text):
        words = WORD.findall(text or "")
        found = plain(words) if len(words) < 10000 else [(0, len(words), 1)]
        return (i, len(words), tuple(found), collapsed(words, found))

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    have = [(r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in got.collect()]
    assert sorted(have, key=key) == sorted((want(*r) for r in rows), key=key)


def test_digests(spark, texts):
    rows = [*texts, (None, "a b " * 6), (7_000_000, "q r s " * 9 + "t " * 18)]
    got = pr.digests(pr.collapse_runs(with_periodic_ends(spark.createDataFrame(rows, "doc_id bigint, text string")))).collect()
    have = {r.doc_id: r for r in got}
    planted = 0
    for i, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[x if x < a else a + (x - a) % p] for x in range(n)]
            planted += 1
        found = plain(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        assert have[i] == Row(doc_id=i, n_runs=len(found), start=best[0], length=best[1], period=best[2],
                              exponent_milli=best[1] and 1000 * best[1] // best[2],
                              runs_sha256=sha("".join(f"{a},{n},{q}\n" for a, n, q in found)),
                              collapsed_sha256=sha(collapsed(words, found))), (i, n)
    assert planted > 10


def test_empty_table(spark, nothing):
    out = pr.digests(pr.collapse_runs(nothing))
    assert out.count() == 0 and out.columns[0] == "doc_id"
