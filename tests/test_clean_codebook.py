import pytest
from pyspark.sql import functions as F

from surveyspark.operators.clean import (drop_sparse_columns, encode_categories, fill_defaults, null_profile,
                                         rename_by_dictionary)
from surveyspark.operators.codebook import (canonical_code, codebook_options, decode_answers, forward_fill, question_labels,
                                            running_sums,
                                            question_types)
from surveyspark.operators.standardize import standardize_categories
from surveyspark.operators.summarize import (extract_field, prompt_completion_pairs, respondent_summary,
                                             sectioned_prompt)


def test_sparse_drop_threshold_is_strict(spark):
    rows = [(1, None, None, 1.0), (2, "a", None, float("nan")), (3, None, None, 2.0), (4, "b", "x", 3.0)]
    df = spark.createDataFrame(rows, "id int, half string, most string, f double")
    prof = {r["column"]: r["null_pct"] for r in null_profile(df).collect()}
    assert prof == {"id": 0.0, "half": 50.0, "most": 75.0, "f": 25.0}
    assert drop_sparse_columns(df, 50).columns == ["id", "half", "f"]


def test_rename_collision_and_fill(spark):
    df = spark.createDataFrame([(1, 2, 3, None)], "Q12 int, Q13 int, Q1 int, Q7 string")
    r = rename_by_dictionary(df, {"Q12": "zeitpunkt", "Q13": "zeitpunkt", "Q1": "geschlecht"})
    assert r.columns == ["zeitpunkt", "zeitpunkt__Q13", "geschlecht", "Q7"]
    f = fill_defaults(spark.createDataFrame([(None, None, float("nan"))], "a string, b int, c double"),
                      {"a": "keine angabe", "b": 99, "c": 99, "missing": 1})
    assert tuple(f.first()) == ("keine angabe", 99, 99.0)


def test_encode_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    got = [tuple(r) for r in encode_categories(df, ["x"]).orderBy(F.col("x").asc_nulls_first()).collect()]
    assert got == [(None, -1), ("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_standardize_rules_and_fuzzy(spark):
    dic = spark.createDataFrame([(0, "aok"), (1, "barmer"), (2, "tk"), (3, "bkk vbu"), (4, "bkk vbu"),
                                 (5, "barmar")], "pos int, term string")
    vals = [None, "Techniker Krankenkasse", "DAK Gesundheit", "A0K Bayern", "Barmr", "xyz", "BKK VBU", "barmxr"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, raw string")
    out = {r["id"]: r["raw"] for r in standardize_categories(df, "raw", dic, 70).collect()}
    assert out[0] == "keine angabe"
    assert out[1] == "tk"
    assert out[2] == "dak"
    assert out[3] == "aok"
    assert out[4] == "barmer"       # one deletion: 100*(1-1/6) = 83 >= 70
    assert out[5] == "xyz"          # below cutoff: lower-cased text kept
    assert out[6] == "bkk vbu"
    assert out[7] == "barmer"       # ties (barmer / barmar both one edit): earliest term wins


def test_scans_keep_null_keys_and_null_buckets(spark):
    rows = [(None, 1, 1.0), (None, 2, None), ("a", 1, None), ("a", 2, 2.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "u string, i int, v double")
    bucket = F.floor(F.col("i") / 2)
    for b in (None, bucket):
        filled = forward_fill(df, ["v"], ["i"], ["u"], bucket=b)
        assert sorted(map(str, filled.collect())) == sorted(
            map(str, df.select("u", "i", F.when(F.col("u").isNull(), 1.0).when(F.col("i") == 2, 2.0).alias("v")).collect()))
        sums = running_sums(df, {"n": F.lit(1)}, ["i"], ["u"], bucket=b)
        assert sums.count() == len(rows)


def test_codes_beyond_64_bits_and_odd_numbers(spark):
    vals = ["1.0", " 2 ", "1e3", "1e30", "Infinity", "NaN", "1d", "x", "-0.5", None, "9223372036854775808"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r["c"] for r in df.select("i", canonical_code(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == ["1", "2", "1000", "1e30", "Infinity", "NaN", "1d", "x", "0", None, "9223372036854775808"]


def test_standardize_equals_scoring_all_pairs(spark):
    import random
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    terms = [word(rng.randint(0, 14)) for _ in range(60)]
    vals = [word(rng.randint(0, 14)) for _ in range(120)] + [t[:-1] + "z" for t in terms if t] + [None, "", "ABCD"]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, raw string")
    dic = spark.createDataFrame([(i, t) for i, t in enumerate(terms)] + [(99, None)], "pos int, term string")
    for cutoff in (70.0, 50.0, 100.0):
        got = {r["id"]: r["raw"] for r in standardize_categories(df, "raw", dic, cutoff).collect()}
        for i, v in enumerate(vals):
            if v is None:
                assert got[i] == "keine angabe"
                continue
            low = v.lower()
            best = max((100.0 * (1 - lev(low, t) / max(len(low), len(t))) if low or t else 100.0, -k, t) for k, t in enumerate(terms))
            if abs(best[0] - cutoff) > 1e-6:
                assert got[i] == (best[2] if best[0] >= cutoff else low), (v, cutoff, best)


def test_forward_fill_plain_and_bucketed(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "o int, v string")
    assert [r["v"] for r in forward_fill(df, ["v"], ["o"]).orderBy("o").collect()] == ["a", "a", "b", "b"]
    ev = spark.createDataFrame([(u, i, None if (i * 7 + u) % 3 == 0 else float(i)) for u in range(3)
                                for i in range(60)], "u int, i int, v double")
    plain = forward_fill(ev, ["v"], ["i"], ["u"]).orderBy("u", "i").collect()
    bucketed = forward_fill(ev, ["v"], ["i"], ["u"], bucket=F.floor(F.col("i") / 7)).orderBy("u", "i").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in bucketed]


CB = [
    (0, "Q1", "Single Select", "S01: Gender", None, "Gender?"),
    (1, None, None, None, "1.0", "male"),
    (2, None, None, None, "2", "female"),
    (3, None, None, None, "2", "female (last wins)"),
    (4, "Q2", "Number Input", "S02: Age", None, None),
    (5, "Q3", "Multiple Select", "S03: Brands", None, "Known brands"),
    (6, "Q3.1", "Multiple Select", None, None, "brand a"),
    (7, None, None, None, "1", "AOK"),
    (8, "Q3.2", "Multiple Select", None, None, "brand b"),
    (9, None, None, None, "1", "TK"),
    (10, "Q4", "Single Matrix", "S04: Matrix", None, "Rate"),
    (11, "Q4.1", "Rating Matrix", None, None, "service"),
    (12, None, None, None, "1", "good"),
    (13, "Q5", "Ranking", "S05: Rank", None, "Rank it"),
    (14, "Q6", "Open Text", "S06: Why", None, "Why?"),
    (15, "Q7", "Rating Scale", "S07: Scale", None, "Scale"),
]
CB_SCHEMA = "row_no bigint, question string, type string, name string, value string, label string"


def test_codebook_tables(spark):
    cb = spark.createDataFrame(CB, CB_SCHEMA)
    opts = {(r["qid"], r["code"]): r["label"] for r in codebook_options(cb).collect()}
    assert opts[("Q1", "1")] == "male" and opts[("Q1", "2")] == "female (last wins)"
    labels = {r["qid"]: r["qlabel"] for r in question_labels(cb).collect()}
    assert labels["Q2"] == "S02: Age"          # no question text: first name
    assert labels["Q3.1"] == "brand a"
    types = {r["qid"]: r["qtype"] for r in question_types(cb).collect()}
    assert types["Q4.1"] == "Rating Matrix" and types["Q1"] == "Single Select"


def test_respondent_summary_text(spark):
    cb = spark.createDataFrame(CB, CB_SCHEMA)
    wide = spark.createDataFrame(
        [("p1", "2", "31", "1", "0", "1", "abc", "rest", "5", "x"),
         ("p2", "9", None, "0", "0", "7", "3.0", None, None, "y"),
         ("p3", None, None, None, None, None, None, None, None, "z")],
        "pid string, Q1 string, Q2 string, `Q3.1` string, `Q3.2` string, `Q4.1` string, Q5 string, Q6 string, "
        "Q7 string, Weight string")
    got = {r["pid"]: r["prompt"] for r in respondent_summary(wide, cb).collect()}
    assert got["p1"] == "\n".join([
        "Participant Summary:", "- Q1 (Gender?): female (last wins)", "- Q2 (S02: Age): 31",
        "- Q5 (Rank it): (invalid rank)", '- Q6 (Why?): "rest"', "- Q7 (Scale): (Unknown rating 5)",
        "- Q3 (Known brands): AOK", "Q4 (Rate):", "  - Q4.1 (service): good", "Answer summary complete."])
    assert got["p2"] == "\n".join([
        "Participant Summary:", "- Q1 (Gender?): (Unknown code 9)", "- Q5 (Rank it): Rank 3", "Q4 (Rate):",
        "  - Q4.1 (service): (Unknown code 7)", "Answer summary complete."])
    assert got["p3"] == "Participant Summary:\nAnswer summary complete."
    d = decode_answers(spark.createDataFrame([("p", 1, "Q1", "1.0")], "pid string, pos int, qid string, value string"),
                       cb).first()
    assert d["answer"] == "male"


def test_field_extraction_and_pairs(spark):
    text = "- Q1 (S01: Gender): Weiblich\n- Q18 (S17: Wechsel): Wechsler l10y\n- Q2 (S02: Age): keine angabe\n"
    df = spark.createDataFrame([(1, text), (2, "- Q1 (S01: Gender): nan\n")], "id int, t string")
    f = {r["id"]: r["v"] for r in df.select("id", extract_field(F.col("t"), r"Q1 \(S01: Gender").alias("v")).collect()}
    assert f == {1: "Weiblich", 2: None}
    cfg = [("Soziodemografie", [(r"Q1 \(S01: Gender", "Die Person ist {}"), (r"Q2 \(S02: Age", "ist {} Jahre alt")]),
           ("Leer", [(r"Q9 \(X", "nie {}")])]
    p = sectioned_prompt(df, "t", cfg, "Intro.").orderBy("id").collect()
    assert p[0]["prompt"] == "Intro.\n\nSoziodemografie:\nDie Person ist Weiblich."
    assert p[1]["prompt"] == "Intro."
    pairs = prompt_completion_pairs(df, "t", cfg, "Intro.", r"Q18 \(S17.*", keys=["id"]).collect()
    assert [(r["id"], r["completion"]) for r in pairs] == [(1, "Wechsler l10y")]


def test_category_codes_distributed_path(spark):
    from surveyspark.operators.clean import category_codes
    df = spark.createDataFrame([(f"v{i % 337:04d}",) for i in range(3000)] + [(None,)], "x string")
    local = {r["_v"]: r["_code"] for r in category_codes(df, "x").collect()}
    spread = {r["_v"]: r["_code"] for r in category_codes(df.repartition(7), "x").collect()}
    assert local == spread and sorted(local.values()) == list(range(337))
