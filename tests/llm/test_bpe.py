import random

import public_tokenizers
import pytest
from brute import sha, tokenizer

from surveyspark.llm import bpe

ALPHABET = "aaab  \n\t\x1c\x85\u00a0\u2003 éñßüabc123١٢½漢字かな🙂'sll'''re.́‍<|endoftext|>"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.tokenizer_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tokenizer(bpe.TOKENIZER_FILE)


def test_random_texts_encode_like_the_library(codec, plain):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" ".join(t.split()) for t in texts]
    assert [list(map(int, j.split(","))) if j else [] for j in codec.encode_joined(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_joined_tokens_encode_like_the_library(codec, plain):
    rng, tokens = random.Random(2), list(codec.rules.ranks)
    for _ in range(2000):
        data = b"".join(rng.choice(tokens) for _ in range(3))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        assert codec.encode(text) == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == data


def test_table_agrees_with_single_prefix_encoding(codec):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abehnt '") for _ in range(rng.randrange(1, 49))) for _ in range(500)]
    assert codec.table.encode(pieces) == [bpe.PrefixEncoding(codec.rules, p).ids() for p in pieces]


def test_append_and_edit_equal_encoding_anew(codec):
    rng = random.Random(4)
    word = lambda n: bytes(rng.choice(b"aabthe n") for _ in range(rng.randrange(n)))
    for _ in range(300):
        data, more = word(150), word(20)
        state = bpe.PrefixEncoding(codec.rules, data)
        state.append(more)
        assert state.last == bpe.PrefixEncoding(codec.rules, data + more).last
        data = data + more
        a = rng.randint(0, len(data))
        b, new = rng.randint(a, len(data)), word(6)
        state.replace(a, b, new)
        anew = bpe.PrefixEncoding(codec.rules, data[:a] + new + data[b:])
        assert (state.data, state.last) == (anew.data, anew.last)


def test_tokens_merging_never_ends_in_stand_only_for_whole_matches():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258}
    rules = bpe.PairRules(ranks)
    assert rules.halves[258] is None and b"abcd" not in {t for t, r in rules.ends.items() if r >= 0}
    assert bpe.PrefixEncoding(rules, b"abcd").ids() == rules.merged(b"abcd")


def test_documents(spark, documents, texts, plain):
    rows = {r.doc_id: r for r in bpe.encode_texts(documents).collect()}
    assert len(rows) == len(texts)
    for i, text in texts:
        ids = plain.encode_ordinary(text or "")
        r = rows[i]
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(text or "")


def test_empty_table(nothing):
    assert bpe.encode_texts(nothing).count() == 0
