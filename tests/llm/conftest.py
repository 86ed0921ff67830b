import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """Rows (doc_id, text): the small table plus edited copies, shared passages and odd texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rng, base, first = random.Random(3), rows[:30], max(i for i, _ in rows) + 1
    passage = base[1][1].split()[:60]
    for k in range(60):
        words = rng.choice(base)[1].split()
        if k % 4 == 0:
            words[len(words) // 2:len(words) // 2] = ["inserted", "here"]
        elif k % 4 == 1:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = f"q{rng.randrange(9)}"
        elif k % 4 == 2:
            words = passage + words[::-1]
        rows.append((first + k, " ".join(words)))
    odd = [None, "", "  \t\n ", "a b c", "A  b\nc", "the the " * 60, "x y z w v", "only\vthese\fsix words are\rhere",
           "z" * 5000, " ".join(f"long{k % 700}" for k in range(9000)), "naïve ÀB " * 9]
    rows += [(first + 100 + k, t) for k, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The rows with columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", k, "u", 1) for k, (i, t) in enumerate(texts)],
                               "doc_id bigint, text string, lang string, id int, block string, n int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
