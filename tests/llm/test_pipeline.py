import corpus_pipeline
from brute import similar, tokenizer, without_repeats

import __spark_entry__

SF001 = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_against_plain_versions(spark, texts, tmp_path):
    items = [(k, t) for k, t in enumerate(" ".join(f"item{k}word{j}" for j in range(20)) for k in range(3))]
    rows = texts + [(90_000, "before it " + items[0][1]), (90_001, items[1][1].upper()), (90_002, "- 12 -"), (90_003, "no item at all")]
    spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    one = similar(want)
    want = [(i, t) for i, t in want if one[i][1] == i]
    cut = without_repeats(want)
    want = [(i, cut[i][2]) for i, _ in want if cut[i][1] < cut[i][0]]
    want = {i: t for i, t in want if i not in (90_000, 90_001)}
    encode = tokenizer("byte_bpe_multi_50k.tiktoken").encode_ordinary

    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: encode(t) for i, t in want.items()}
    assert 90_003 in got and 90_002 not in got


def test_repeated_ids_null_ids_and_no_labels(spark):
    one, two, clean = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, one), (1, two), (1, one), (2, one + " z"), (3, two + " z"), (None, clean), (None, clean), (4, "- 12 -"), (5, None), (6, "short")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], COLUMNS)
    lettered = corpus_pipeline.language(spark, docs, "")
    assert lettered.count() == 8 and lettered.columns == list(corpus_pipeline.COLUMNS)
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, lettered, "").collect()))
    assert got == sorted([(1, one), (1, two), (0, clean), (0, clean), (6, "short")])


def test_mixed_languages_stay(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"),
                                                        ("el gato y el perro", "es")] * 9)]
    mixed = "the cat and the dog. der hund und die katze. le chat et le chien. el gato y el perro."
    docs = spark.createDataFrame([(k, t, lang, "s", 1) for k, t, lang in rows] + [(1000, mixed, None, "s", 1), (1001, "漢字", None, "s", 1)], COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {k for k, *_ in rows} | {1000}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
