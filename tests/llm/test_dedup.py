import numpy as np
import pytest
from brute import roots, sha, similar, without_repeats
from pyspark.sql import functions as F

from surveyspark.llm import embedding_dedup, ngram_join, substring_dedup
from surveyspark.llm.components import components


@pytest.mark.parametrize("block_bytes", [1 << 23, 20_000])
def test_substring_dedup(documents, texts, block_bytes):
    want = without_repeats(texts)
    got = substring_dedup.remove_repeats(documents, carry=("lang", "id"), block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert all(r.kept_sha256 == sha(r.kept) and r.lang == "en" for r in got)
    assert sum(w[1] for w in want.values()) > 1000


def test_substring_dedup_other_periods(documents, texts):
    got = substring_dedup.remove_repeats(documents, width=9, period=3, cover=(0, 1)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == without_repeats(texts, 9)
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(documents, period=7, cover=(0, 1))


def test_substring_dedup_ids_that_are_null_or_repeated(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (7, text)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in got) == [
        ((False, 5), 0), ((False, 5), 0), ((False, 7), 30), ((True, 0), 30)]


@pytest.mark.parametrize("block_bytes", [1 << 23, 20_000])
def test_ngram_join(documents, texts, block_bytes):
    want = similar(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(documents, block_bytes=block_bytes).collect()}
    assert got == want
    assert sum(c != i for i, (_, c) in want.items()) > 20


def test_ngram_join_ids_that_are_repeated_with_another_text(spark):
    one, two = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, one), (1, two), (2, [*one[:-1], "z"]), (3, [*two[:-1], "z"]), (3, [*two[:-1], "z"]), (4, ["alone"]), (None, one), (5, []), (5, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = ngram_join.similar(docs, with_first=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.component_id, r.first) for r in got), key=key) == sorted(
        [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (None, None, True), (5, 5, True), (5, 5, True)], key=key)


def test_ngram_join_near_copies_that_do_not_link_with_each_other(spark):
    """Copies of one text with edits at different places: linked through the text, if at all."""
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for e in range(k % 9):
            words[(37 * k + 17 * e) % 150] = f"x{k}_{e}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, " ".join(base[k:])) for k in range(0, 40, 3)]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == similar(rows)


def test_ngram_join_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e F")]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (3, 3), (3, 3), (9, 3)] or \
        sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("9", "3"), ("None", "None")]


def test_empty_tables(spark, nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert ngram_join.similar(nothing).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)] + [(7, None), (8, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    want = roots(sorted({x for ab in links for x in ab if x is not None}), [(a, b) for a, b in links if b is not None])
    assert got == {n: r for n, r in want.items() if n != r}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    near = x[:40].repeat(4, 0) + 0.07 * rng.standard_normal((160, 16)).astype(np.float32)
    vectors = [v.tolist() for v in np.concatenate([x, near, x[:5], x[:5], 3 * x[5:8]])]
    usable = len(vectors)
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 3, []]
    rows = [(i * 3, v, "extra") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x string").repartition(4)
    unit = np.array(vectors[:usable], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    for piece in (2048, 7):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, piece=piece).collect()}
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got.values())
        assert found <= hit.sum() and found >= 0.9 * hit.sum()
        for i in range(usable, len(rows)):
            assert (got[3 * i].n_links, got[3 * i].component_id, got[3 * i].kept) == (0, 3 * i, True)
        for k in range(5):  # the copies, however found
            assert got[3 * (560 + k)].component_id == got[3 * k].component_id == got[3 * (565 + k)].component_id
        if found == hit.sum():
            assert {i: got[3 * i].n_links for i in range(usable)} == dict(enumerate(hit.sum(1).tolist()))
            component = roots(range(usable), np.argwhere(hit).tolist())
            assert {i: got[3 * i].component_id for i in range(usable)} == {i: 3 * c for i, c in component.items()}


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for width, n in ((16, 300), (24, 300), (5, 40)):
        x = rng.standard_normal((n, width))
        vectors += [*x.tolist(), *(x[:30] + 1e-4 * rng.standard_normal((30, width))).tolist()]
    vectors += [[2.0], [0.5], [-3.0], [-1.0], [0.0], []]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(4)
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for v in vectors]
    hit = [(i, j) for i, u in enumerate(unit) for j, v in enumerate(unit) if i != j and len(u) == len(v) and u @ v >= 0.95]
    want = roots(range(len(vectors)), hit)
    for piece in (2048, 7):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, piece=piece).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert sum(r.n_links for r in got.values()) == len(hit) and all(got[i].n_links for i, _ in hit)


def test_embeddings_of_any_scale(spark):
    vectors = [[1e-200, 2e-200], [2.0, 1.0], [1e200, 2e200], [1.0, 2.0], [5e-324, 0.0], [1.0, 0.0], [1.7e308, 1.7e308], [1e-308, 1e-308]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    # cosine of (1, 2) and (2, 1): 0.8; of (1, 1) and (1, 2): 0.949
    assert got == {0: (2, 0), 1: (0, 1), 2: (2, 0), 3: (2, 0), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_embedding_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.95).sum()) - len(rows)
    found = embedding_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * links <= found <= links
