import random
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import sha

from surveyspark.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(public_tokenizers.path(alignment.FILE_A), public_tokenizers.path(alignment.FILE_B))


def whole(pair, text):
    """(n_a, n_b, groups text, links) of a whole text, encoded at once, byte by byte."""
    nothing = (0, 0, "", [])
    if not text:
        return nothing
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    data = (" " + text).encode()
    spans = []
    for ids, bytes_of in ((a, pair.bytes_a), (b, pair.bytes_b)):
        if b"".join(bytes_of[i] for i in ids) != data:
            return nothing
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(bytes_of[i])))
            at = own[-1][1]
        spans.append(own)
    covers = [[k for k, (s, e) in enumerate(own) for _ in range(s, e)] for own in spans]
    links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*covers))]
    cut = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = []
    end_at = [{e: k for k, (_, e) in enumerate(own)} for own in spans]
    low = [0, 0]
    for high in cut:
        to = [at[high] + 1 for at in end_at]
        groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), low, to)))
        low = to
    return len(a), len(b), ";".join(groups), links


def brute(pair, rows):
    found = [(i, *whole(pair, t)) for i, t in rows]
    held = Counter(x for *_, links in found for x in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(i, na, nb, groups.count(";") + bool(groups), len(links), sum(held[x] == best[x[0]] for x in links),
             sum(held[x] for x in links), sha(groups) if groups else "", groups) for i, na, nb, groups, links in found]


ODD = ["  two  spaces ", "tab\tand\nline \n feed", "▁ in it", "naïve ÀB über Straße", "語の文章は空白がない。", "a b c　d", "😀😀 👩‍👩‍👧 x", "<s> <unk> <0x41> <|endoftext|>",
       "word " * 50, "x" * 3000, "1234567890 3.14 -- ... !!!", "don't I'll we've", " ", "\n", "a", "Ⅷ ½ ² ﬁ", "\x00 \x1c a \x1d b", "é é", "नमस्ते दुनिया", "a ́b"]


def test_parts_encode_like_the_whole_text(pair):
    """Every character, in front of and behind a safe space and between two of them."""
    rng = random.Random(2)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    chars = chars[:0x3200] + rng.sample(chars[0x3200:], 20_000)
    texts = [f"a{c} {c}b {c} {d}c" for c, d in zip(chars, rng.sample(chars, len(chars)))]
    a = [e.ids for e in pair.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    b = pair.b.encode(texts)
    parts = [alignment._SAFE_SPACE.split(t) for t in texts]
    pa_, pb = pair.encode([p for ps in parts for p in ps])
    at = 0
    for t, ps, x, y in zip(texts, parts, a, b):
        assert [i for ids in pa_[at:at + len(ps)] for i in ids] == x, ascii(t)
        assert [i for ids in pb[at:at + len(ps)] for i in ids] == y or "▁" in t, ascii(t)
        at += len(ps)


def test_ranks_encode_like_the_merges(pair):
    """Every character below the border between letters, digits, marks and spaces, and random texts of them."""
    rng = random.Random(6)
    chars = [chr(c) for c in range(ord(alignment.BEYOND))]
    texts = [f"{x}{c}{y}" for c in chars for x in ("", "a", "1", " ", "!") for y in ("", "b", "2", " c", "?")]
    texts += ["".join(rng.choice(chars[:600]) for _ in range(rng.randrange(1, 60))) for _ in range(5000)]
    texts += ["".join(rng.choice("aeinorst '") for _ in range(200)) for _ in range(3000)]
    assert pair.ranked is not None
    got = [pair.ranked(" " + t) for t in texts]
    assert got == [e.ids for e in pair.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_gallop():
    rng = random.Random(3)
    for _ in range(100):
        ends = sorted(rng.sample(range(200), rng.randrange(1, 60))) + [200]
        value, at = [np.array([rng.randrange(n) for _ in range(30)]) for n in (201, len(ends))]
        want = [next(k for k in range(a, len(ends)) if ends[k] >= v) for v, a in zip(value, at)]
        assert alignment.gallop(np.array(ends), value, at).tolist() == want


def test_align_against_all_ranges():
    rng = random.Random(4)
    for _ in range(150):
        a, b, at = [[]], [[]], 0  # ends of several texts, one after the other
        for _ in range(rng.randrange(6)):
            n = rng.choice([1, 2, 5, 40])
            for x in (a, b):
                x.append([at + e for e in sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n})])
            at += n
        flat = [[e for t in x for e in t] for x in (a, b)]
        first = [np.cumsum([len(t) for t in x]) for x in (a, b)]
        i, j, cut_a, cut_b = alignment.align(np.array(flat[0], np.int64), first[0], np.array(flat[1], np.int64), first[1])
        spans = [list(zip([0, *x], x)) for x in flat]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(i.tolist(), j.tolist())) == want
        assert cut_a.tolist() == [e in flat[1] for e in flat[0]] and cut_b.tolist() == [e in flat[0] for e in flat[1]]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 20_000])
def test_against_plain_version(spark, texts, pair, block_bytes):
    rows = [*texts, *((800_000 + k, t) for k, t in enumerate(ODD)), (None, "a null id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(i, t, 1, "g", "b") for i, t in rows], "doc_id bigint, text string, n_a int, groups string, block string")
    out = alignment.align_texts(df.repartition(3), block_bytes=block_bytes)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in out.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(brute(pair, rows), key=order)
    assert sum(r[1] == 0 for r in got) >= 3 and sum(r[3] < min(r[1], r[2]) for r in got) > 20


def test_empty_table(spark, nothing):
    out = alignment.align_texts(nothing, with_groups=False)
    assert out.count() == 0 and "groups" not in out.columns
