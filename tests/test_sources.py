import json
import tempfile

from surveyspark.operators.clean import rename_by_dictionary
from surveyspark.operators.summarize import config_from_table, sectioned_prompt
from surveyspark.sources.lookups import name_map, read_name_map, read_template_config, read_term_list


def test_lookup_files(spark):
    d = tempfile.mkdtemp(prefix="lookups-", dir="/tmp")
    with open(f"{d}/terms.json", "w", encoding="utf-8") as f:
        json.dump(["aok", "tk", "ikk südwest", "tk"], f, ensure_ascii=False)
    with open(f"{d}/names.json", "w", encoding="utf-8") as f:
        json.dump({"Q1": "geschlecht", "Q12": "zeitpunkt", "Q13": "zeitpunkt"}, f)
    with open(f"{d}/config.csv", "w", encoding="utf-8") as f:
        f.write('group_pos,group,field_pos,pattern,template\n1,Herkunft,1,"Q1 \\(S01.*","ist {}"\n')
    terms = [tuple(r) for r in read_term_list(spark, f"{d}/terms.json").orderBy("pos").collect()]
    assert terms == [(0, "aok"), (1, "tk"), (2, "ikk südwest"), (3, "tk")]
    m = name_map(read_name_map(spark, f"{d}/names.json"))
    assert m == {"Q1": "geschlecht", "Q12": "zeitpunkt", "Q13": "zeitpunkt"}
    df = spark.createDataFrame([(1, 2, 3)], "Q1 int, Q12 int, Q13 int")
    assert rename_by_dictionary(df, m).columns == ["geschlecht", "zeitpunkt", "zeitpunkt__Q13"]
    cfg = config_from_table(read_template_config(spark, f"{d}/config.csv"))
    assert cfg == [("Herkunft", [(r"Q1 \(S01.*", "ist {}")])]
    txt = spark.createDataFrame([("- Q1 (S01: Gender): Weiblich",)], "t string")
    assert sectioned_prompt(txt, "t", cfg, "Intro.").first()["prompt"] == "Intro.\n\nHerkunft:\nist Weiblich."


def test_term_lines(spark):
    import os

    from surveyspark.plans import QUERIES
    from surveyspark.sources.lookups import read_term_lines, write_term_lines

    path = tempfile.mkdtemp(prefix="lookups-", dir="/tmp") + "/terms"
    terms = [(k, f'a "b"\n\\ü {k}\r') for k in range(50)] + [(50, "")]
    write_term_lines(spark.createDataFrame(terms, "pos bigint, term string").repartition(5), path)
    assert sum(x.startswith("part-") for x in os.listdir(path)) == 5
    assert sorted(tuple(r) for r in read_term_lines(spark, path).collect()) == terms
    sf = "/root/testdata/sf0.001"
    got = QUERIES["term_list_roundtrip"](spark, sf)
    names = sorted({r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()})
    assert sorted(tuple(r) for r in got.collect()) == list(enumerate(names))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no list exploded from one row


def test_small_operators(spark):
    from pyspark.sql import functions as F

    from surveyspark.operators.chat import chat_dataset
    from surveyspark.operators.compare import alias_names
    from surveyspark.operators.crosstab import csv_field, grid_lines, question_index_text
    from surveyspark.operators.score import keyword_coverage
    from surveyspark.operators.sentiment import sentiment_lexicon

    lex = spark.createDataFrame([("gut", 1.0), ("schlecht", -2.0)], "word string, score double")
    s = sentiment_lexicon(spark.createDataFrame([(1, "Gut gut schlecht"), (2, None), (3, "sehr gut")],
                                                "id int, t string"), "t", lex, ["id"])
    assert {r["id"]: r["sentiment"] for r in s.collect()} == {1: "neutral", 2: "neutral", 3: "positive"}

    fs = spark.createDataFrame([(1, [("tax", ["tax", "ta"])], "the taxi")],
                               "id int, f array<struct<feature:string,synonyms:array<string>>>, t string")
    sub = keyword_coverage(fs, "f", "t").first()
    whole = keyword_coverage(fs, "f", "t", whole_word=True).first()
    assert sub["matched_keyword_count"] == 1 and whole["matched_keyword_count"] == 0

    pairs = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(40)], "k int, p string, c string")
    d = chat_dataset(pairs, "k", "p", "c", 0.9, 42).collect()
    assert sum(r["split"] == "train" for r in d) == 36
    assert [m["role"] for m in d[0]["messages"]] == ["system", "user", "assistant"]

    al = spark.createDataFrame([("gpt-4o-mini",), ("some/model name",)], "n string")
    lut = spark.createDataFrame([("gpt-4o-mini", "gpt4o_base")], "name string, alias string")
    assert sorted(r["alias"] for r in alias_names(al, "n", lut).collect()) == ["gpt4o_base", "some_model_name"]

    cells = spark.createDataFrame([("f", 1, 0, 0, "a"), ("f", 1, 0, 2, 'x,"y"'), ("f", 1, 2, 1, "b")],
                                  "file string, question_no long, row_no long, col_no int, value string")
    lines = {r["row_no"]: r["line"] for r in grid_lines(cells).collect()}
    assert lines == {0: 'a,,"x,""y"""', 1: ",,", 2: ",b,"}
    assert spark.range(1).select(csv_field(F.lit(None).cast("string"))).first()[0] == ""
    idx = spark.createDataFrame([("f", 2, "out_002.csv", "T2", None), ("f", 1, "out_001.csv", "T1", "S1")],
                                "file string, question_no long, file_name string, title string, subtitle string")
    assert question_index_text(idx).first()["text"] == "out_001.csv\nT1\nS1\n\nout_002.csv\nT2"
