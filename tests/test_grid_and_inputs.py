import random

from pyspark.sql import functions as F

from surveyspark.operators.broadcast import small_side
from surveyspark.operators.crosstab import grid_lines, number_lines, read_lines
from surveyspark.sources.tables import table

from conftest import SF001


def csv_field(v):
    if v is None:
        return ""
    return '"' + v.replace('"', '""') + '"' if any(ch in v for ch in '",\r\n') else v


def test_grid_lines_equal_dense_layout(spark):
    """Dense CSV lines of sparse tables, built by hand: leading and inner missing rows,
    missing columns, fields that need quoting, a one-cell table."""
    rng = random.Random(3)
    cells = {}
    for q in range(1, 9):
        n = 1 if q == 1 else rng.randint(2, 25)
        for _ in range(n):
            r, c = rng.randint(0, 12), rng.randint(0, 30)
            cells[("f", q, r, c)] = rng.choice(["a", "b c", 'q"x', "1,5", "z"])
    rows = [(f, q, r, c, v) for (f, q, r, c), v in cells.items()]
    df = spark.createDataFrame(rows, "file string, question_no bigint, row_no bigint, col_no int, value string")
    got = {(x["question_no"], x["row_no"]): x["line"] for x in grid_lines(df).collect()}
    exp = {}
    for q in {k[1] for k in cells}:
        mine = {(r, c): v for (_, qq, r, c), v in cells.items() if qq == q}
        mr = max(r for r, _ in mine)
        mc = max(c for _, c in mine)
        for r in range(mr + 1):
            exp[(q, r)] = ",".join(csv_field(mine.get((r, c))) for c in range(mc + 1))
    assert got == exp


def test_grid_keeps_rows_behind_the_last_cell(spark):
    cells = spark.createDataFrame([("f", 1, 0, 1, "a")], "file string, question_no bigint, row_no bigint, col_no int, value string")
    high = spark.createDataFrame([("f", 1, 3)], "file string, question_no bigint, n_rows bigint")
    got = sorted((r["row_no"], r["line"]) for r in grid_lines(cells, heights=high).collect())
    assert got == [(0, ",a"), (1, ","), (2, ",")]


def test_filters_and_columns_reach_the_scan(spark):
    plan = table(spark, SF001, "documents").filter(F.col("doc_id") < 10).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(doc_id,10)" in plan and "ReadSchema: struct<doc_id:bigint>" in plan


def test_rewritten_table_is_not_read_stale(spark, tmp_path):
    for n in (3, 5):
        spark.range(n).withColumnRenamed("id", "r_regionkey").write.mode("overwrite").parquet(f"{tmp_path}/region.parquet")
        assert table(spark, str(tmp_path), "region").count() == n


def test_lines_of_large_files_are_numbered_across_splits(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(want) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["line_no"], r["line"]) for r in got] == list(enumerate(want))


def test_line_ends(spark):
    df = spark.createDataFrame([("f", "a\n"), ("g", "a\r\nb\x0cc\u2028d"), ("h", ""), ("i", "a\n\n")], "f string, t string")
    got = sorted((r["file"], r["line_no"], r["line"]) for r in number_lines(df, "f", "t").collect())
    assert got == [("f", 0, "a"), ("g", 0, "a"), ("g", 1, "b"), ("g", 2, "c"), ("g", 3, "d"), ("h", 0, ""), ("i", 0, "a"), ("i", 1, "")]


def test_small_side_broadcasts_only_below_the_bound(spark):
    big = spark.range(0, 5000).withColumnRenamed("id", "k")
    lut = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = big.join(small_side(lut), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    plan = big.join(small_side(lut, max_rows=10), "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert big.join(small_side(lut, max_rows=10), "k").count() == 50


def test_checkpoint_folder_when_the_setting_is_absent(tmp_path):
    """A local session without ``spark.checkpoint.dir`` (no defaults file) still
    checkpoints: the scratch folder is registered with the context, not the config."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from surveyspark.session import cut_lineage\n"
        "print(cut_lineage(s.range(7)).count(), cut_lineage(s.range(3)).count())\n"
    ) % repo
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "7 3"


def test_rows_of_cells_equal_cells(spark):
    """Words as rows of cells give the tables and lines that single cells give; cells are taken apart behind the joins only."""
    import random

    from surveyspark.operators.crosstab import combine_blocks, crosstab_questions, crosstab_sections, question_tables, words_as_cells, words_in_rows

    rng = random.Random(11)
    word = lambda: rng.choice(["", "a", "b,c", 'q"', "dd", "Summe"])
    texts = [(f, "\n".join(rng.choice(["-", "-", " ".join(word() for _ in range(rng.randrange(1, 7))), "x", " y"]) for _ in range(90))) for f in range(4)]
    lines = number_lines(spark.createDataFrame(texts + [(9, "a\r\nb\n")], "file long, text string"), "file", "text").localCheckpoint()
    sec = crosstab_sections(lines, F.col("line") == "-").localCheckpoint()
    own = crosstab_questions(sec)
    tables = combine_blocks(sec, own)
    want = combine_blocks(sec, own, words_as_cells(sec)).localCheckpoint()
    assert sorted(tuple(r) for r in tables.collect()) == sorted(tuple(r) for r in want.collect())
    plan = tables._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Join")  # tree from the top: explode, below it the joins
    got = grid_lines(combine_blocks(sec, own, in_rows=True))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in grid_lines(want).collect())
    rows = words_in_rows(lines.withColumnRenamed("line_no", "row_no"))
    assert {tuple(map(tuple, (r.cols, r.vals))) for r in rows.filter("file = 9").collect()} == {((0,), ("a",)), ((0,), ("b",))}
    cells = lines.select("file", F.col("line_no").alias("row_no"), F.posexplode(F.split("line", " ")).alias("col_no", "value"))
    cells = cells.withColumn("value", F.nullif("value", F.lit("")))
    for chunk in (7, 4096):
        a = sorted(tuple(r) for r in question_tables(rows, chunk_rows=chunk).collect())
        assert a and a == sorted(tuple(r) for r in question_tables(cells).collect())
