import random
import re

import pytest
from brute import sha
from pyspark.sql import functions as F

from surveyspark.llm import pii
from surveyspark.llm.queries import op12_pii

RUN = r"[0-9]([\x20-]?[0-9])+"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": RUN, "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "short_card": RUN,
    "local_phone": r"[0-9(][0-9() /-]{5,17}[0-9]", "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text):
    """[(kind, start, end, score, text)] by re over the plain patterns."""
    out = []
    for kind in pii.KINDS:
        hits = [(m.start(), m.end()) for m in re.finditer(PLAIN[kind.name], text)]
        size = {"card": (16, 19), "short_card": (13, 15)}.get(kind.name)
        if size:
            hits = [(a, b) for a, b in hits if size[0] <= len(re.sub("[^0-9]", "", text[a:b])) <= size[1]]
        for k, (a, b) in enumerate(hits):
            t, digits = text[a:b], re.sub("[^0-9]", "", text[a:b])
            before = text[hits[k - 1][1] if k else 0:a][-pii.BESIDE:]
            after = text[b:hits[k + 1][0] if k + 1 < len(hits) else len(text)][:pii.BESIDE]

            def alone(beside="A-Za-z0-9", before=before, after=after):
                return not re.search(f"[{beside}]\\Z", before) and not re.match(f"[{beside}]", after)

            code = t.replace(" ", "")
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in t.split(".")), "card": lambda: luhn(digits),
                  "phone": lambda: 8 <= len(digits) <= 15,
                  "iban": lambda: 15 <= len(code) <= 34 and alone() and mod97(code),
                  "short_card": lambda: luhn(digits) and alone("A-Za-z0-9+."),
                  "local_phone": lambda: 7 <= len(digits) <= 12 and alone("A-Za-z0-9+.()/-"),
                  "national_id": lambda: not re.search("^(000|666|9)|-00-|0000", t) and alone("A-Za-z0-9+.-")}[kind.name]()

            def says(words, before=before, after=after):
                return any(re.search(rf"(^|[^a-z]){w}([^a-z]|\Z)", re.sub("[A-Z]", lambda m: m[0].lower(), x))
                           for w in words for x in (before, after))

            score = min(1.0, round(kind.prior + 0.3 * says(kind.near) - 0.3 * says(kind.far), 3))
            if ok and (kind.base or score >= 0.5):
                out.append((kind.name, a, b, score, t))
    return out


def odd_texts():
    rng = random.Random(11)
    parts = ["a@b.c", "_d@e.f", "x.y+z%w@q-1.co.uk", "@", "a@b", "@e.f", "1.2.3.4", "256.1.1.1", "0255.0.00.1", "9" * 30 + ".1.2.3", "5.6.7", ".",
             "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "4381893557741609", "1234567890123456", "378282246310005", "3782 822463 10005",
             "+1 (743) 555-3824", "+12", "+123", "+1 2345678..-", "+49 30 1234 5678 90", "030/1234567", "(030) 123-4567", "call", "Tel:", "visa", "SKU",
             "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "GB29NWBK60161331926818", "123-45-6789", "000-12-3456", "ssn", "über", "語", "7", " ", "-", "\n", ",", "x"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(700)]
    texts += ["".join(rng.choice("a1 .-+@A(") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choice("12 -.") for _ in range(rng.randrange(80))) for _ in range(400)]
    values = [x for x in parts if len(x) > 9]
    for _ in range(300):
        words = rng.choices(["call", "Tel:", "visa", "SKU", "ssn", "iban", "version", "x", "ü"], k=5) + rng.choices(values, k=3)
        rng.shuffle(words)
        texts.append(" ".join(words))
    return texts


def test_against_plain_patterns(spark, texts):
    rows = [*enumerate(odd_texts()), *((10_000 + k, t) for k, (_, t) in enumerate(texts))]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, kind string, spans int").repartition(8)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(df).collect()}
    want = {i: spans(t or "") for i, t in rows}
    assert got == want
    kinds = [s[0] for found in want.values() for s in found]
    assert all(kinds.count(k.name) > 5 for k in pii.KINDS)
    have = {r.doc_id: r for r in pii.digests(pii.find_personal_data(df)).collect()}
    for i, found in want.items():
        base = [s for s in found if s[0] in pii.BASE]
        assert [have[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert have[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in base))
        assert have[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def test_long_runs_and_many_spans(spark):
    """Neither a long run nor thousands of spans cost the square of their length, or the stack."""
    long = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a." * 100_000 + "@", "+1" + "(" * 200_000, "( " * 100_000, "1.1." * 50_000,
            "a@b.c " * 3_000 + "1.2.3.4 " * 700]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(df).collect()}
    assert sorted(k for k in got if got[k]) == [6, 7]
    assert got[7] == [("email", 6 * k, 6 * k + 5) for k in range(3_000)] + [("ip", 18_000 + 8 * k, 18_007 + 8 * k) for k in range(700)]
    assert len(got[6]) == 25_000


def test_checksums(spark):
    rows = [("4111111111111111", True, False), ("4111111111111112", False, False), ("DE89370400440532013000", None, True),
            ("DE88370400440532013000", None, False), ("FR1420041010050500013M02606", None, True)]
    df = spark.createDataFrame(rows, "x string, luhn boolean, iban boolean")
    assert df.where((F.col("luhn") != pii.luhn(F.col("x"))) & F.col("luhn").isNotNull()).count() == 0
    assert df.where(F.col("luhn").isNull() & (F.col("iban") != pii.mod97(F.col("x")))).count() == 0


def test_edge_cases(spark, nothing, tmp_path):
    df = spark.createDataFrame([(None, "a@b.c"), (1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.digests(pii.find_personal_data(df)).collect())
    assert got == [(0, 1, "email:0:5"), (1, 0, ""), (2, 0, ""), (3, 1, "email:0:5"), (3, 1, "email:0:5")]
    assert pii.digests(pii.find_personal_data(nothing)).count() == 0
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    plan = op12_pii(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_one_kind(spark):
    df = spark.createDataFrame([(1, "a@b.c 1.2.3.4")], "doc_id bigint, text string")
    kinds = tuple(k for k in pii.KINDS if k.name == "ip")
    assert [s.kind for s in pii.find_personal_data(df, kinds=kinds).first().spans] == ["ip"]
    with pytest.raises(AttributeError):
        kinds[0].name = "other"
