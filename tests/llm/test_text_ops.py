import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import tokenizer
from pyspark.sql import functions as F

from surveyspark.llm import chat_format, decontam, lang_id, lm_score, token_counts, url_filter

SF001 = "/root/testdata/sf0.001"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_spans_scripts_and_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog went home", "en"), ("der hund und die katze gehen nach hause", "de"),
                                   ("кошка и собака пошли домой", "ru"), (None, "en"), ("no label", None)], "text string, lang string")
    model = lang_id.fit(train)
    assert set(model.langs) == {"en", "de", "ru"}
    rows = [(1, "the cat went home and the dog. Der hund und die katze gehen nach hause"), (2, None), (3, "12 - 34"), (4, ""),
            (5, "漢字"), (6, "the cat кошка и собака пошли домой the dog"), (7, "the dog went home " * 3000)]
    df = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id int, text string, score double")
    got = {r.doc_id: r for r in lang_id.identify(df, model).collect()}
    assert [(s.lang, s.first, s.last) for s in got[1].lang_spans] == [("en", 0, 6), ("de", 7, 14)]
    assert [(got[k].lang_pred, got[k].score) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[5].lang_pred in model.langs and got[5].score == 0.0
    assert got[6].lang_pred == "ru" and {s.lang for s in got[6].lang_spans} == {"en", "ru"}
    assert (got[7].lang_pred, got[7].score) == ("en", 1.0)


def test_language_in_a_script_without_ranges(spark):
    import corpus_pipeline

    telugu, kannada = "పిల్లి మరియు కుక్క ఇంటికి వెళ్ళాయి", "ಬೆಕ್ಕು ಮತ್ತು ನಾಯಿ ಮನೆಗೆ ಹೋದವು"
    rows = [(k, (telugu, "te") if k % 3 else ("the cat and the dog went home", "en")) for k in range(60)]
    df = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, (t, lang) in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in lang_id.predict_languages(df).collect()}
    assert {k: (got[k].lang_pred, got[k].score) for k, _ in rows} == {k: (lang, 1.0) for k, (_, lang) in rows}
    assert corpus_pipeline.language(spark, df, "").count() == 60
    model = lang_id.fit(df.unionByName(df.limit(1).withColumn("text", F.lit(kannada * 9)).withColumn("lang", F.lit("kn"))))
    odd = spark.createDataFrame([(1, kannada), (2, telugu)], "doc_id int, text string")
    assert {r.doc_id: r.lang_pred for r in lang_id.identify(odd, model).collect()} == {1: "kn", 2: "te"}
    # without Telugu in the model, its letters weigh against a few Latin ones, also inside one word
    latin = lang_id.fit(df.where("lang = 'en'"))
    odd = spark.createDataFrame([(1, telugu + " the " + telugu), (2, telugu.replace(" ", "\u00a0") + "the")], "doc_id int, text string")
    assert all(r.lang_pred == "en" and 0 < r.score < 0.2 for r in lang_id.identify(odd, latin).collect())


def test_letters_of_listed_scripts_outside_the_ranges():
    name = lambda c: lang_id.SCRIPTS[lang_id._KIND[ord(c)]][0]
    assert [name(c) for c in "เーꙀﬀక"] == ["Thai", "Kana", "Cyrillic", "Latin", "Other"]
    assert all(lang_id._KIND[ord(c)] == 255 for c in "“—1👍\u0c3f")


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(2)
    count = np.array([3, 0, 5, 1])
    first = np.array([0, 3, 3, 8])
    score = rng.normal(0, 3, (9, 3)).astype(np.float32)
    path = lang_id.viterbi(score, first, count, 2.0)
    import itertools

    for f, n in zip(first, count):
        value = lambda p: sum(score[f + k, s] for k, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        if n:
            assert value(tuple(path[f:f + n])) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-4)


def test_language_without_training_rows(spark, nothing):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in lang_id.predict_languages(df).collect()] == ["und"]
    assert lang_id.predict_languages(nothing).count() == 0


def plain_tiles(text, item, least):
    """Longest common unmarked stretch, again and again."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and free_t[p + n] and free_i[q + n] and text[p + n] == item[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        free_t[p:p + n], free_i[q:q + n] = [False] * n, [False] * n
        out.append(best)


def test_tiling_equals_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        text = [rng.randrange(4) for _ in range(rng.randrange(40))]
        item = [rng.randrange(4) for _ in range(rng.randrange(40))]
        assert decontam.tiling(text, item, 3) == plain_tiles(text, item, 3)


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve".split()
    other = [f"o{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "too short"), (5, "")], "item_id bigint, text string")
    noise = [f"n{k}" for k in range(400)]
    docs = [(10, " ".join(noise + item + noise)), (11, " ".join(item[6:] + noise[:3] + item[:6]).upper()), (12, " ".join(item[:5] + noise)),
            (13, " ".join(other[:14])), (14, " ".join(other[:15])), (15, None), (16, ""), (17, "too short"), (18, "! ".join(item) + "?"),
            (18, " ".join(item + other))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, leaks string")
    for chunk in (16 << 20, 40):
        got = decontam.find_leaks(df, items, chunk_bytes=chunk).select("doc_id", F.explode("leaks").alias("l")).collect()
        assert sorted((r.doc_id, r.l.item_id, round(r.l.coverage, 3), r.l.longest, r.l.tiles) for r in got) == [
            (10, 1, 1.0, 12, 1), (11, 1, 1.0, 6, 2), (14, 2, 0.5, 15, 1), (17, 4, 1.0, 2, 1), (18, 1, 1.0, 12, 1), (18, 1, 1.0, 12, 1), (18, 2, 1.0, 30, 1)]
    assert decontam.find_leaks(df.limit(0), items).count() == 0
    assert decontam.find_leaks(df, items.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_leaks_of_short_and_unspaced_items(spark, tmp_path):
    import corpus_pipeline
    from surveyspark.llm import queries

    items = [(1, "Capital of France?"), (2, "今天天气很好我们去公园。"), (3, "ตอบคำถามต่อไปนี้"), (4, "capital  of france"), (5, "。?"),
             (6, "eins zwei drei vier fünf sechs"), (7, "why")]
    docs = [(10, "what is the capital of France, please"), (11, "他说今天天气很好我们去公园吧"), (12, "กรุณาตอบคำถามต่อไปนี้ครับ"),
            (13, "capital of all France"), (14, "“eins—zwei\u3000drei”\u00a0vier…fünf«sechs»"), (15, "why not, why"), (16, None), (17, "whys 。?")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id): (r.coverage, r.longest, r.tiles) for r in queries.op6_decontamination(spark, str(tmp_path)).collect()}
    assert set(got) == {(10, 1), (10, 4), (11, 2), (12, 3), (14, 6), (15, 7)}
    assert [got[10, 1], got[11, 2], got[14, 6], got[15, 7]] == [(1.0, 3, 1), (1.0, 11, 1), (1.0, 6, 1), (1.0, 1, 1)]
    assert got[12, 3][0] == 1.0
    kept = corpus_pipeline.benchmark_leaks(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [13, 16, 17]


@pytest.mark.parametrize("chunk_blocks", [1, 2, 4096])
def test_separator_scan(spark, chunk_blocks):
    rng, rows, want = random.Random(chunk_blocks), [], []
    for file in range(7):
        ids = [rng.choice([0, 1, 2, 50256] if file < 4 else [1] * 60 + [50256]) for _ in range(rng.choice([1, 57, 400]))]
        ids = [50256, 50256] if file == 6 else ids
        open_, number = 0, 0
        for x in ids:
            if x == 50256:
                want.append((file, number, open_, True))
                open_, number = 0, number + 1
            else:
                open_ += 1
        want += [(file, number, open_, False)] if open_ else []
        rows += [(file, b // 7, bytearray(np.array(ids[b:b + 7], np.uint16).tobytes())) for b in range(0, len(ids), 7)]
    df = spark.createDataFrame(rows, "file bigint, block bigint, data binary").repartition(3)
    got = token_counts.count_documents(df, chunk_blocks=chunk_blocks).collect()
    assert sorted((r.file, r.number, r.n_tokens, r.finished) for r in got) == sorted(want)


def test_flat_files(spark, tmp_path):
    for k, docs in enumerate([[3, 0, 500], [], [70]]):
        ids = [x for n in docs for x in [5] * n + [50256]]
        np.array(ids, np.uint16).tofile(tmp_path / f"part{k}.bin")
    blocks = token_counts.read_files(spark, str(tmp_path), block_tokens=64)
    names = {r.file: r.path[-5] for r in blocks.select("file", "path").distinct().collect()}
    got = token_counts.count_documents(blocks).collect()
    assert sorted((names[r.file], r.number, r.n_tokens) for r in got) == [("0", 0, 3), ("0", 1, 0), ("0", 2, 500), ("2", 0, 70)]


def test_documents_as_flat_files(spark, documents, texts, nothing):
    encode = tokenizer("byte_bpe_50k.tiktoken").encode_ordinary
    blocks = token_counts.write_blocks(documents, block_tokens=1000)
    got = token_counts.count_documents(blocks, chunk_blocks=3).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(encode(t or ""))) for i, t in texts)
    assert all(r.finished for r in got)
    assert token_counts.count_documents(token_counts.write_blocks(nothing)).count() == 0


@pytest.mark.parametrize("block_bytes", [4 << 20, 30_000])
def test_cross_entropy_difference(spark, documents, texts, nothing, block_bytes):
    encode = tokenizer("byte_bpe_multi_50k.tiktoken").encode_ordinary
    wanted = {i for i, _ in texts[::3]}
    labels = spark.createDataFrame([(i, int(i in wanted), 0) for i, _ in texts] + [(texts[0][0], 0, 0), (None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    pairs = {i: (lambda s: list(zip(s, s[1:])))([50256, *encode(t or ""), 50256]) for i, t in texts}
    models = []
    for use in (wanted, set(pairs)):
        two, one = Counter(), Counter()
        for i in use:
            two.update(pairs[i])
            one.update(w for _, w in pairs[i])
        models.append((two, one, sum(one.values())))
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(documents, labels, block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, p in pairs.items():
        loss = []
        for (two, one, n), counted in zip(models, (i in wanted, True)):  # the document's own counts are taken off
            own2, own1 = (Counter(p), Counter(w for _, w in p)) if counted else (Counter(), Counter())
            n -= len(p) * counted
            loss.append(sum(-math.log((two[h, w] - own2[h, w] + 20 * (one[w] - own1[w] + 1) / (n + 50257)) / (one[h] - own1[h] + 20))
                            for h, w in p) / len(p))
        if len(p) == 1:
            assert (got[i].n_tokens, got[i].score) == (0, None)
        else:
            assert (got[i].target_loss, got[i].background_loss) == pytest.approx(loss, abs=1e-6)
            assert got[i].score == pytest.approx(loss[0] - loss[1], abs=1e-6)
    assert lm_score.cross_entropy_difference(nothing, labels).count() == 0


def test_a_target_document_does_not_gain_by_its_own_counts(spark):
    rows = [(k, " ".join(f"w{(k * 37 + j * j) % 400}" for j in range(200))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = lambda wanted: {r.doc_id: r.target_loss for r in lm_score.cross_entropy_difference(
        docs, spark.createDataFrame([(i, 1) for i in wanted], "doc_id bigint, quality int")).collect()}
    out, among = own(range(10)), own(range(11))
    assert among[10] == pytest.approx(out[10], abs=1e-12)


def test_one_id_in_a_third_of_the_rows(spark):
    rows = [(1, f"hot text {k} " * 20) for k in range(300)] + [(k, f"text {k} " * 20) for k in range(2, 600)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = lm_score.cross_entropy_difference(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"), block_bytes=4000)
    assert got.count() == len(rows) and got.where("doc_id = 1").count() == 300


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\</s>\\\\<s>", "<|image:1|>", "<\\/s>", "<<s>[[INST]", None, "", "\\n x\n<\\br>", "é漢<</SYS>>"]
    roles = ["user", "assistant", "as\nsi<\\br></s>"]
    rows = [(k // 3, k % 3, roles[k % 3], t, "x") for k, t in enumerate(nasty)] + [(None, None, None, "n", "x"), (9, 1, "assistant", "y" * 20000, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, piece string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t, _ in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), digest(loss))
    assert chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    rows = [(1, 1, "user", [("text", "see ", None, None), ("image", None, "a.png", 2), ("document", None, "b.pdf", 3)]),
            (1, 2, "assistant", [("audio", None, "c.wav", None), ("text", " ok", None, None), ("video", None, "z", None)]), (1, 3, "user", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, parts " + chat_format.PARTS)
    r = chat_format.format_chats(df).first()
    assert r.formatted == "<s>user\nsee <|image:1|><|document:2|></s><s>assistant\n<|audio:3|> ok<|other:4|></s><s>user\n</s>"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, "image", "a.png", 512), (2, "document", "b.pdf", 1536), (3, "audio", "c.wav", 25), (4, "other", "z", 0)]
    assert r.attachment_tokens == 2073 and [r.formatted[s.start:s.end] for s in r.loss_spans] == ["<|audio:3|> ok<|other:4|>"]


URLS = [(1, None, "", "", None), (2, "nothing", "", "", None), (3, "http://A.Net/x", "a.net", "/x", "net/"), (4, "http://a.net", "a.net", "", None),
        (5, "x://y.example.NET/en/?q", "y.example.net", "/en/", "example.net/en/"), (6, "http://example.net/en", "example.net", "/en", "net/"),
        (7, "http://bexample.com/de/1#a", "bexample.com", "/de/1", None), (8, "http://org/fr/?a=1&b=2", "org", "/fr/", "org/fr/"),
        (9, "http://e.com?x=/de/", "e.com", "", None), (10, "http://a.example.com/de/#x/?", "a.example.com", "/de/", "example.com/de/"),
        (11, "", "", "", None), (12, "a://b://c.net/", "b:", "//c.net/", None), (12, "http://É.NET/" + "x" * 9000, "É.net", "/" + "x" * 9000, "net/")]


def test_url_rules_and_trees(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u, *_ in URLS], "page_id int, url string, host string")
    got = url_filter.judge(df).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got if r.page_id != 12) == [(i, h, p, r) for i, _, h, p, r in URLS if i != 12] or \
        {(r.page_id, r.host, r.path, r.rule) for r in got} == {(i, h, p, r) for i, _, h, p, r in URLS}
    said = dict((b, a) for a, b in url_filter.RULES)
    for r in got:
        assert r.verdict == said[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.where("page_id in (2, 7)")).collect()} == {"allow"}


def test_url_suffix_rates_count_all_labelled_urls(spark):
    blocked = {f"s{k}.test": hashlib.md5(str(k).encode()).digest()[0] % 2 == 1 for k in range(100, 160)}
    rules = [("block" if b else "allow", f"{d}/a/") for d, b in blocked.items()]
    rows = [(k, f"http://{d}/{path}/{x}") for k, d in enumerate(blocked) for path, x in (("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"))]
    df = spark.createDataFrame(rows, "page_id int, url string")
    got = url_filter.judge(df, rules=rules, sample=25).where("rule is null").collect()
    assert {r.host: r.verdict == "block" for r in got} == blocked
    labelled = df.where("url like '%/a/%'").distinct().select(url_filter.host_and_path(F.col("url"))[0].alias("host"), F.lit(1.0).alias("label"))
    rates = url_filter.suffix_rates(labelled)
    assert {r.rate2 for r in rates["2"].collect()} == {3 / 4} and rates["2"].count() == 60
    assert [tuple(r) for r in rates["1"].collect()] == [("test", 121 / 122)]


def test_url_plan_is_native(spark):
    plan = url_filter.judge(spark.read.parquet(f"{SF001}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
