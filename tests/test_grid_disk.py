import os
import random
import time

from surveyspark.operators.crosstab import combine_blocks, grid_lines
from surveyspark.plans import QUERIES
from surveyspark.session import checkpoint_dir

from conftest import SF001



def shuffled(spark):
    """The shuffle files of this session."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("|").split("|") if "/shuffle_" in f}


def sparse_sections(rng):
    """Data lines of files with sections, blocks and rows, many words empty, and their questions."""
    word = lambda: rng.choice(["", "", "a", "b,c", 'q"', "dd"])
    rows, own = [], []
    for f in range(5):
        for sec in range(6):
            if rng.random() < 0.8:  # else its question was dropped
                own.append((f, sec, sec // 2 + 1))
            for block in range(rng.randint(1, 3)):
                width = rng.randint(1, 9)
                rows += [(f, sec, "data", block + 10 * sec, r, " ".join(word() for _ in range(rng.randint(1, width)))) for r in range(rng.randint(1, 4))]
    return rows, own


def combined_plainly(rows, own):
    """Cells of the questions' tables, one column after the other."""
    question, out = {(f, s): q for f, s, q in own}, {}
    tables = {}
    for f, s, _, b, r, line in rows:
        if (f, s) in question:
            cells = tables.setdefault((f, question[f, s]), {}).setdefault((s, b), {})
            cells.update({(r, c): w for c, w in enumerate(line.split(" ")) if w})
    for (f, q), blocks in tables.items():
        n = 0
        for k, key in enumerate(sorted(blocks)):
            for c in sorted({c for _, c in blocks[key]}):
                if k == 0 or c >= 2:
                    out.update({(f, q, r, n): w for (r, cc), w in blocks[key].items() if cc == c})
                    n += 1
    return out


def test_stretches_of_columns_equal_single_columns(spark):
    rows, own = sparse_sections(random.Random(23))
    sec = spark.createDataFrame(rows, "file long, section long, role string, block long, row_in_block long, line string")
    questions = spark.createDataFrame(own, "file long, section long, question_no long")
    want = combined_plainly(rows, own)
    got = combine_blocks(sec, questions).collect()
    assert {(r.file, r.question_no, r.row_no, r.col_no): r.value for r in got} == want and len(got) == len(want)
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set('",') else v
    lines = {}
    for f, q in {k[:2] for k in want}:
        own = [k[2:] for k in want if k[:2] == (f, q)]
        for r in range(max(r for r, _ in own) + 1):
            lines[f, q, r] = ",".join(quoted(want.get((f, q, r, c), "")) for c in range(max(c for _, c in own) + 1))
    got = grid_lines(combine_blocks(sec, questions, in_rows=True)).collect()
    assert {(r.file, r.question_no, r.row_no): r.line for r in got} == lines and len(got) == len(lines)


def test_grid_lines_leave_little_on_disk(spark):
    """What the steps of the query shuffle, and the tables that its lines do not read, are gone when it is made."""
    before, folder = shuffled(spark), checkpoint_dir(spark)
    there = set(os.listdir(folder))
    lines = QUERIES["grid_lines"](spark, SF001)
    for _ in range(20):  # files are removed in the background
        if not (kept := shuffled(spark) - before):
            break
        time.sleep(0.5)
    assert not kept
    new = {p.split("/")[-2] for p in lines.inputFiles()}
    assert set(os.listdir(folder)) - there == new and all(n.startswith("table-") for n in new)
    assert lines.count() > 0
