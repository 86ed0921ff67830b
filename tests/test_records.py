"""Records whose separator may stand inside quotes, read in splits of any size."""

import csv
import io
import json
import random

import pytest

from surveyspark.operators.crosstab import cells_from_csv
from surveyspark.sources.records import JSON_OPENS, JSON_STAYS, read_records

SPLITS = ["1024", "128m"]


@pytest.fixture(params=SPLITS)
def splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1" if request.param == "1024" else "4m"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def plain_cells(text):
    """Cells by the csv module: blank lines skipped, empty fields missing."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return sorted((k, j, v) for k, r in enumerate(rows) for j, v in enumerate(r) if v != "")


def got_cells(spark, path):
    return sorted((r.row_no, r.col_no, r.value) for r in cells_from_csv(spark, str(path)).collect())


def test_commas_on_both_sides_of_a_quoted_line_break(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a\nb",c,d,"x\ny",e,f\nshort\n\n1,,3,"q""uo,te"\n')
    assert got_cells(spark, tmp_path / "a.csv") == [
        (0, 0, "a\nb"), (0, 1, "c"), (0, 2, "d"), (0, 3, "x\ny"), (0, 4, "e"), (0, 5, "f"), (1, 0, "short"),
        (2, 0, "1"), (2, 2, "3"), (2, 3, 'q"uo,te')]


@pytest.mark.parametrize("seed", range(3))
def test_csv_against_the_csv_module(spark, tmp_path, splits, seed):
    rng = random.Random(seed)
    alphabet = ["a", "ü", "7", " ", ",", "\n", '"', "\n\n", '"\n"', "語"]
    end = ["\n", "\r\n"][seed % 2]
    lines = []
    for k in range(400):
        fields = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 40 if k % 50 else 1500]))) for _ in range(rng.randrange(1, 7))]
        # a quote inside a field that does not begin with one needs no quoting
        lines.append(",".join(f if f and f[0] != '"' and not set(f) & {",", "\n"} and rng.random() < 0.7
                              else '"' + f.replace('"', '""') + '"' for f in fields))
        if rng.random() < 0.1:
            lines.append("")
    text = end.join(lines) + ("" if seed == 2 else end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    assert got_cells(spark, tmp_path / "a.csv") == plain_cells(text)
    assert len(text.encode()) > 20_000
    if splits == "1024":
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 8


def test_files_are_numbered_one_by_one(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("" if k == 1 else f'{k},"x\n{k}"\n{k}\n')
    got = sorted((r.file[-5:], r.row_no, r.col_no, r.value) for r in cells_from_csv(spark, str(tmp_path)).collect())
    assert got == [(f"{k}.csv", *c) for k in (0, 2) for c in ((0, 0, str(k)), (0, 1, f"x\n{k}"), (1, 0, str(k)))]


def test_unclosed_quote_runs_to_the_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\nc,"d\ne,f\n')
    assert got_cells(spark, tmp_path / "a.csv") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d\ne,f")]


def test_json_pieces(spark, tmp_path, splits):
    rng = random.Random(9)
    doc = [{f"k{rng.choice('}{ a')}{j}": rng.choice(["}", '"', "\\", "x}y{", "\\\"}", "plain", "ü\n"]) for j in range(rng.randrange(1, 9))}
           for _ in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(doc, ensure_ascii=False))
    rows = read_records(spark, str(tmp_path / "a.json"), "}", JSON_OPENS, JSON_STAYS).collect()
    texts = [r.text for r in sorted(rows, key=lambda r: r.record_no)]
    assert [json.loads(t.lstrip("[, ") + "}") for t in texts[:-1]] == doc and texts[-1] == "]"
