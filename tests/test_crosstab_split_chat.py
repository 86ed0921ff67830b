import random

import pytest
from pyspark.sql import functions as F

from surveyspark.operators.chat import collect_messages, render_full, render_role_tag, template_error
from surveyspark.operators.crosstab import (BLANK_ROW, combine_blocks, crosstab_questions, crosstab_sections,
                                            question_index, question_tables)
from surveyspark.operators.split import split_holdout, split_stratified

B = BLANK_ROW


def fold_reference(lines, keep_tail=True):
    """Plain sequential reading of the dump rules, used as the brute-force oracle:
    returns [(title, subtitle, [blocks of rows])] of kept questions."""
    out, cur, blocks, data, state, blanks = [], None, [], [], 0, 0
    for ln in lines:
        if ln == B:
            if data:
                blocks.append(data)
                data = []
            blanks += 1
            if blanks > 1:
                state = 0
            continue
        blanks = 0
        if state == 0:
            title = ln.strip(",")
            if cur is None or title not in cur[:2]:
                if cur is not None and blocks:
                    out.append((cur[0], cur[1], blocks))
                cur, blocks, contd = [title, None], [], False
            else:
                contd = True
        elif state == 1:
            if not contd:
                cur[1] = ln.strip(",")
        else:
            data.append(ln)
        state += 1
    if keep_tail and data:
        blocks.append(data)
    if cur is not None:
        out.append((cur[0], cur[1], blocks))
    return out


def random_dump(rng, n):
    titles = ["Q A", "Q B", "Q C", "sub 1", "sub 2"]
    lines = []
    for _ in range(n):
        r = rng.random()
        if r < 0.25:
            lines.append(B)
        elif r < 0.45:
            lines.append(rng.choice(titles) + ",,")
        else:
            lines.append(",".join(rng.choice(["", "1", "x", "y"]) for _ in range(4)))
    return lines


def test_crosstab_matches_sequential_rules(spark):
    rng = random.Random(5)
    files = {f"f{i}": random_dump(rng, rng.randint(3, 40)) for i in range(120)}
    rows = [(f, i, ln) for f, ls in files.items() for i, ln in enumerate(ls)]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, line string")
    for keep_tail, chunk in ((True, None), (False, None), (True, 4), (False, 7)):
        sec = crosstab_sections(lines, keep_tail=keep_tail, chunk_lines=chunk)
        if chunk:
            plain = crosstab_sections(lines, keep_tail=keep_tail).collect()
            assert sorted(tuple(r) for r in sec.collect()) == sorted(tuple(r) for r in plain)
        qs = crosstab_questions(sec).collect()
        idx = {(r["file"], r["question_no"]): (r["title"], r["subtitle"]) for r in question_index(
            crosstab_questions(sec)).collect()}
        data_rows = {}
        for r in sec.filter(F.col("role") == "data").join(
                crosstab_questions(sec).select("file", "section", "question_no"), ["file", "section"]).collect():
            data_rows.setdefault((r["file"], r["question_no"]), []).append(r["line_no"])
        for f, ls in files.items():
            exp = fold_reference(ls, keep_tail)
            got = sorted((k[1], v) for k, v in idx.items() if k[0] == f)
            assert [(t, s) for t, s, _ in exp] == [v for _, v in got], (f, ls)
            for qn, (_, _, blocks) in enumerate(exp, start=1):
                assert sum(len(b) for b in blocks) == len(data_rows.get((f, qn), [])), (f, qn)
        assert qs is not None


def fold_heads(heads):
    """Plain fold of the continuation rule over ordered (title, subtitle, has_data):
    [(title, subtitle, question_no)] per section of a kept question, else None."""
    state, q, out = None, 0, []
    for t, s, hd in heads:
        if state is None or t not in (state[0], state[1]):
            state, q = (t, s), q + 1
        out.append((q, state[0], state[1], hd))
    qdata = {}
    for qq, _, _, hd in out:
        qdata[qq] = max(qdata.get(qq, 0), hd)
    kept = sorted(qq for qq in qdata if qdata[qq] or qq == q)
    num = {qq: i + 1 for i, qq in enumerate(kept)}
    return [(t, s, num[qq]) if qq in num else None for qq, t, s, _ in out]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 64])
def test_question_scan_over_chunks_equals_plain_fold(spark, chunk):
    rng = random.Random(100 + chunk)
    titles = ["A", "B", "C", "D"]
    files, expected = {}, {}
    for i in range(6):
        lines, heads = [], []
        for _ in range(rng.randint(1, 60)):
            t = rng.choice(titles)
            sub = rng.choice(titles + [None])
            ndata = rng.choice([0, 0, 1, 2])
            lines.append(t)
            if sub is not None or ndata:
                lines.append(sub if sub is not None else "x")
            lines += ["1,2"] * ndata
            lines += [B, B]
            heads.append((t, sub if sub is not None else ("x" if ndata else None), int(ndata > 0)))
        files[f"h{i}"] = lines
        expected[f"h{i}"] = fold_heads(heads)
    rows = [(f, j, ln) for f, ls in files.items() for j, ln in enumerate(ls)]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, line string")
    sec = crosstab_sections(lines)
    got = crosstab_questions(sec, chunk_sections=chunk).collect()
    secs = sorted({(r["file"], r["section"]) for r in sec.filter(F.col("role") == "title").collect()})
    by = {(r["file"], r["section"]): (r["title"], r["subtitle"], r["question_no"]) for r in got}
    for f in files:
        order = [k for k in secs if k[0] == f]
        assert [by.get(k) for k in order] == expected[f], f


def test_combine_blocks_drops_leading_columns_and_empty_ones(spark):
    ls = ["Title,,", "Sub,,", "a,b,,c", "d,e,,f", B, "g,h,,i", "j,k,,", B, B]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(ls)], "file string, line_no bigint, line string")
    sec = crosstab_sections(lines)
    cells = (sec.filter(F.col("role") == "data")
             .select("file", "section", "block", "row_in_block", F.posexplode(F.split("line", ",")).alias("col_no", "value"))
             .withColumn("value", F.when(F.col("value") == "", None).otherwise(F.col("value")))
             .withColumn("col_no", F.col("col_no").cast("int")))
    out = combine_blocks(sec, crosstab_questions(sec), cells)
    grid = {(r["row_no"], r["col_no"]): r["value"] for r in out.collect()}
    # block 1: columns a b c (empty third dropped); block 2: first two dropped -> i
    assert grid == {(0, 0): "a", (0, 1): "b", (0, 2): "c", (1, 0): "d", (1, 1): "e", (1, 2): "f", (0, 3): "i"}


def test_question_tables_title_rows(spark):
    grid = [["junk", "x"], ["Frage 1"], ["r", "1", "2"], [], ["Gesamt"], ["Frage 2"], ["Frage 3"], ["s", "3", "4"],
            ["Frage 1"], ["t", "5", None, "6"]]
    rows = [("f", i, j, v) for i, cells in enumerate(grid) for j, v in enumerate(cells or [None])]
    cells = spark.createDataFrame(rows, "file string, row_no bigint, col_no int, value string")
    out = question_tables(cells).collect()
    got = {(r["title"], r["row_no"], r["col_no"]): r["value"] for r in out}
    sheets = {r["title"]: r["sheet"] for r in out}
    assert set(sheets) == {"Frage 1", "Frage 3"}          # Frage 2 has no table; junk before first title dropped
    assert sheets["Frage 1"] == "000 Frage 1" and sheets["Frage 3"] == "001 Frage 3"
    # Frage 1: first table r,1,2 (+ blank row + 'Gesamt' row), second table t,5,6 -> its columns after the first two
    assert got[("Frage 1", 0, 0)] == "r" and got[("Frage 1", 0, 2)] == "2"
    assert got[("Frage 1", 2, 0)] == "Gesamt"
    assert got[("Frage 1", 0, 3)] == "6"


def test_split_is_exact_stable_partition(spark):
    df = spark.range(0, 5003).withColumn("label", (F.col("id") % 3).cast("int"))
    s1 = split_holdout(df, "id", 0.9, 42)
    s2 = split_holdout(df.repartition(13), "id", 0.9, 42)
    a = {r["id"]: r["split"] for r in s1.collect()}
    b = {r["id"]: r["split"] for r in s2.collect()}
    assert a == b and len(a) == 5003
    assert sum(v == "train" for v in a.values()) == int(0.9 * 5003)
    st = split_stratified(df, "id", "label", 0.8, 42).groupBy("label", "split").count().collect()
    counts = {(r["label"], r["split"]): r["count"] for r in st}
    for lab in range(3):
        n = sum(v for (l2, _), v in counts.items() if l2 == lab)
        assert counts[(lab, "train")] == int(0.8 * n)


def test_render_full_and_tools(spark):
    conv = spark.createDataFrame([(1, 0, "system", " Be brief. "), (1, 1, "user", "Hi "), (1, 2, "assistant", "Ho"),
                                  (2, 0, "user", "Only")], "conv_id int, turn int, role string, text string")
    m = collect_messages(conv, ["conv_id"])
    got = {r["conv_id"]: r["t"] for r in m.select("conv_id", render_full("messages", True).alias("t")).collect()}
    head = ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\n"
            "Today Date: 26 Jul 2024\n\n")
    assert got[1] == (head + "Be brief.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nHi<|eot_id|>"
                      "<|start_header_id|>assistant<|end_header_id|>\n\nHo<|eot_id|>"
                      "<|start_header_id|>assistant<|end_header_id|>\n\n")
    assert got[2].startswith(head + "<|eot_id|><|start_header_id|>user")
    rt = {r["conv_id"]: r["t"] for r in m.select("conv_id", render_role_tag("messages").alias("t")).collect()}
    assert rt[1] == "<|system|>\nBe brief.\n<|user|>\nHi\n<|assistant|>\nHo"

    msgs = spark.createDataFrame(
        [(1, [("user", "Find it", None), ("assistant", "", [("search", {"q": "x"})]), ("tool", 'a "b"', None)]),
         (2, [("user", "x", None), ("assistant", "", [("a", {}), ("b", {})])])],
        "id int, messages array<struct<role:string,content:string,"
        "tool_calls:array<struct<name:string,arguments:map<string,string>>>>>")
    tools = [{"name": "search"}]
    r = {x["id"]: (x["t"], x["e"]) for x in msgs.select(
        "id", render_full("messages", tools=tools).alias("t"), template_error("messages").alias("e")).collect()}
    t1 = r[1][0]
    assert "Environment: ipython\n" in t1
    assert '{\n    "name": "search"\n}\n\nFind it<|eot_id|>' in t1
    assert '<|start_header_id|>assistant<|end_header_id|>\n\n{"name": "search", "parameters": {"q": "x"}}<|eot_id|>' in t1
    assert t1.endswith('<|start_header_id|>ipython<|end_header_id|>\n\n"a \\"b\\""<|eot_id|>')
    assert r[2][0] is None and r[2][1] is not None


def test_question_table_sink_round_trip(spark):
    import tempfile
    from surveyspark.operators.crosstab import write_question_tables
    ls = ["T1,,", "S1,,", "a,b,c", B, B, "T2,,", "S2,,", "d,e,f", "g,h,i", B]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(ls)], "file string, line_no bigint, line string")
    sec = crosstab_sections(lines)
    cells = (sec.filter(F.col("role") == "data")
             .select("file", "section", "block", "row_in_block", F.posexplode(F.split("line", ",")).alias("col_no", "value"))
             .withColumn("col_no", F.col("col_no").cast("int")))
    tables = combine_blocks(sec, crosstab_questions(sec), cells)
    out = tempfile.mkdtemp(prefix="qtables-", dir="/tmp")
    write_question_tables(tables, out + "/t")
    back = spark.read.parquet(out + "/t")
    assert sorted(r["question_no"] for r in back.select("question_no").distinct().collect()) == [1, 2]
    assert back.filter("question_no = 2").count() == 6 and {r["file"] for r in back.collect()} == {"f"}


def test_question_tables_chunked_equals_windowed(spark):
    import random as _r
    rng = _r.Random(9)
    rows = []
    for f in range(30):
        for i in range(rng.randint(5, 60)):
            n = rng.choice([1, 1, 2, 3, 4])
            for j in range(n):
                v = rng.choice(["Frage A", "Frage B", "Gesamt", "x", "1", None]) if n == 1 else rng.choice(["a", None, "3"])
                rows.append((f"f{f}", i, j, v))
    cells = spark.createDataFrame(rows, "file string, row_no bigint, col_no int, value string")
    a = sorted(tuple(r) for r in question_tables(cells).collect())
    for chunk in (1, 5):
        assert a == sorted(tuple(r) for r in question_tables(cells, chunk_rows=chunk).collect())
    assert len(a) > 0


def test_splits_keep_every_row(spark):
    rows = [(None if i % 9 == 0 else i, None if i % 4 == 0 else i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, y int")
    for out in (split_holdout(df, "k", 0.8), split_stratified(df, "k", "y", 0.8)):
        assert out.count() == len(rows) and {r["split"] for r in out.select("split").distinct().collect()} == {"train", "validation"}
    n = {r["y"]: r["count"] for r in split_stratified(df.filter("k is not null"), "k", "y", 0.5).filter("split = 'train'").groupBy("y").count().collect()}
    total = {r["y"]: r["count"] for r in df.filter("k is not null").groupBy("y").count().collect()}
    assert n == {y: c // 2 for y, c in total.items()}
    assert split_holdout(df.limit(0), "k").count() == 0


def test_render_full_branches(spark):
    kind = "id int, messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:map<string,string>>>>>"
    call = [("search", {"q": "x", "n": "2"})]
    m = spark.createDataFrame([(1, [("system", "S", None), ("user", "Hi", None), ("assistant", "", call), ("tool", "r", None)]),
                               (2, []), (3, [("system", "S", None)]), (4, [("user", None, None)])], kind)
    plain = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    got = {r["id"]: r["t"] for r in m.select("id", render_full(plain).alias("t")).collect()}
    assert '<|start_header_id|>ipython<|end_header_id|>\n\n"r"<|eot_id|>' in got[1] and got[2] is None and got[4] is not None
    tools = [{"name": "other"}]
    got = {r["id"]: (r["t"], r["e"]) for r in m.select(
        "id", render_full("messages", tools=tools).alias("t"), template_error("messages").alias("e")).collect()}
    assert got[2][0] is None and "no messages" in got[2][1] and got[3][0] is None and "first user message" in got[3][1]
    t = m.filter("id = 1").select(render_full("messages", tools=tools, builtin_tools=["search", "code_interpreter"],
                                              tools_in_user_message=False).alias("t")).first()["t"]
    assert "Environment: ipython\nTools: search\n\nCutting" in t and '"name": "other"\n}\n\nS<|eot_id|>' in t
    assert '<|python_tag|>search.call(q="x", n="2")<|eom_id|>' in t
