"""Records in splits and batches of any size: only what a split's border cuts is shuffled."""

import csv
import io
import random

import pytest

from surveyspark.operators.crosstab import cells_from_csv
from surveyspark.sources.records import read_csv_records


@pytest.fixture(params=[("1024", "3"), ("1024", "10000"), ("128m", "7")])
def sizes(spark, request):
    split, batch = request.param
    names = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def lines(seed, count):
    rng = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for k in range(count):
        w.writerow(["".join(rng.choice(["a", "ü", ",", "\n", '"', "\n\n"]) for _ in range(rng.choice([0, 1, 5, 2500 if k % 90 == 0 else 20])))
                    for _ in range(rng.randrange(1, 6))] + [str(k)])
    return out.getvalue()


def test_records_of_several_files(spark, tmp_path, sizes):
    want = []
    for k in range(3):
        text = lines(k, 120) + ('"open\nto,the\n\nend' if k == 1 else "")
        (tmp_path / f"{k}.csv").write_text(text)
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        want += [(f"{k}.csv", n, [v or None for v in r]) for n, r in enumerate(rows)]
    got = sorted((r.file[-5:], r.record_no, r["values"]) for r in read_csv_records(spark, str(tmp_path)).collect())
    assert got == sorted(want, key=lambda r: r[:2])


def test_names_of_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,,"b\nc",\n,d\n"",\n"x"\n')
    cells = lambda by: sorted((r.key, r.row_no, r.col_no, r.value) for r in cells_from_csv(spark, str(tmp_path), named_by=by).collect())
    assert cells("first") == [("a", 0, 0, "a"), ("a", 0, 2, "b\nc"), ("x", 3, 0, "x")]
    assert cells("last") == [("b\nc", 0, 0, "a"), ("b\nc", 0, 2, "b\nc"), ("d", 1, 1, "d"), ("x", 3, 0, "x")]


def test_whole_records_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text(lines(5, 200))
    plan = read_csv_records(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "_cut" in plan
