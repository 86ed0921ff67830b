"""Language identification of mixed-language texts.

A word (a run of letters) may only be in a language whose training texts use one of its
scripts (code point ranges; all scripts without ranges are one, Other). Among those, byte n-gram counts score the word, and a Viterbi pass
over the words of a text, with a penalty for every change of language, labels the spans. The
text's language is the one that labels most letters.

Training counts every labelled text it is given (no sample): per task at most
``len(ORDERS) * CELLS`` rows per language are sent, and the model has that size.

Edge cases: null text, or no letter at all: ``und``, score 0, no spans; letters only in scripts
that no trained language uses: the language with most training letters, score 0; very long
texts are labelled whole; rows whose label is null do not train; ties go to the language with
more training letters, then to the smaller name; an empty table gives an empty result; with no
training rows every text is ``und``; other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import returning, slices

ORDERS = (2, 3, 4)
CELLS = 1 << 16  # hashed n-grams per order
SLICE = 1 << 19
SWITCH = 6.0  # log penalty of a change of language
SPREAD = 8.0  # a word speaks at most this strongly against a language
SMOOTH = 0.5
SCRIPT_SHARE = 0.01  # a language uses a script that holds this share of its letters

UND = "und"

# Script ranges, fixed values of the Unicode standard (first, last code point). Letters of these
# scripts outside the ranges count too; letters of all other scripts count as Other.
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8),
               (0x1E00, 0x1EFF))),
    ("Greek", ((0x370, 0x373), (0x376, 0x377), (0x37A, 0x37D), (0x37F, 0x37F), (0x386, 0x386), (0x388, 0x3FF),
               (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x481), (0x48A, 0x52F))),
    ("Armenian", ((0x531, 0x556), (0x561, 0x587))),
    ("Hebrew", ((0x5D0, 0x5EA),)),
    ("Arabic", ((0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F))),
    ("Devanagari", ((0x904, 0x939), (0x958, 0x961))),
    ("Bengali", ((0x985, 0x9B9),)),
    ("Tamil", ((0xB85, 0xBB9),)),
    ("Thai", ((0xE01, 0xE30),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Hangul", ((0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3))),
    ("Kana", ((0x3041, 0x3096), (0x30A1, 0x30FA))),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
    ("Other", ()),
)
_LETTER = regex.compile(r"\p{L}")
_NO_LETTER = 255


def _kinds() -> np.ndarray:
    """Number of the script of every code point, ``_NO_LETTER`` for what is no letter."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))  # no letters in the planes above
    place = lambda k: k if k < 0xD800 else k + 0x800
    kind = np.full(0x110000, _NO_LETTER, np.uint8)
    for m in regex.finditer(r"\p{L}+", every):
        kind[place(m.start()):place(m.end() - 1) + 1] = len(SCRIPTS) - 1
    letters = "".join(map(chr, np.flatnonzero(kind != _NO_LETTER).tolist()))
    for k, (name, _) in reversed([*enumerate(SCRIPTS[:-1])]):
        named = "Hiragana}\\p{scx=Katakana" if name == "Kana" else name
        for c in regex.findall(rf"[\p{{scx={named}}}]", letters):
            kind[ord(c)] = k
    for k, (_, spans) in enumerate(SCRIPTS):
        for a, b in spans:
            kind[a:b + 1] = k
    return kind


_KIND = _kinds()

# bytes of the character that a byte begins (0: none), and the bits that its first byte adds
_LENGTH = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.uint8)
_LEAD = np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint8)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Letters:
    """The letter runs of a slice of texts, their n-gram cells and their scripts."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8") for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n\n\n\n", np.uint8)
        self.bytes = _FOLD[data]
        border = np.cumsum([0] + [len(r) + 1 for r in raw])  # place of the line feed in front of each text
        solid = self.bytes != 0x20
        self.start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        self.end = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        self.first = np.searchsorted(self.start, border)
        self.count = np.diff(self.first)
        n = len(self.bytes) - 3
        b = [self.bytes[k:n + k].astype(np.uint32) for k in range(4)]
        open_ = b[1] != 0x20
        cell, self.cells = b[0] * np.uint32(257) + b[1], {}
        for order in range(2, 5):
            if order > 2:
                cell = cell * np.uint32(0x9E3779B1) + np.where(open_, b[order - 1], 0)
                open_ = open_ & (b[order - 1] != 0x20)
            mixed = cell * np.uint32(0x85EBCA6B)
            self.cells[order] = (mixed ^ (mixed >> np.uint32(15))) >> np.uint32(16)
        self._scripts(data)

    def _scripts(self, data: np.ndarray) -> None:
        """``letters``: letters of each word; ``script``: bits of its scripts; and per letter."""
        size = _LENGTH[data]
        at = np.flatnonzero((size > 1) | ((size == 1) & (self.bytes != 0x20)))
        size = size[at]
        padded = np.append(data, np.zeros(4, np.uint8))
        point = (padded[at] & _LEAD[size]).astype(np.int32)
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            point[more] = point[more] << 6 | (padded[at[more] + k] & 0x3F)
        kind = _KIND[point]
        letter = kind != _NO_LETTER
        self.letter_script = kind[letter].astype(np.int64)
        self.letter_word = np.searchsorted(self.start, at[letter], "right") - 1
        self.letters = np.bincount(self.letter_word, minlength=len(self.start))
        self.script = np.zeros(len(self.start), np.int64)
        np.bitwise_or.at(self.script, self.letter_word, np.int64(1) << self.letter_script)

    def gram_places(self) -> np.ndarray:
        """Places at which an n-gram begins: a letter, or the gap in front of one."""
        solid = self.bytes != 0x20
        n = len(self.cells[2])
        return np.flatnonzero(solid[:n] | solid[1:n + 1])


def train_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, order, cell, n); order 0 holds letters per script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(text, SLICE):
                names = batch.column(0).slice(a, b - a).to_pylist()
                langs = sorted(set(names))
                number = np.array([langs.index(x) for x in names], np.int64)
                w = Letters([t or "" for t in text.slice(a, b - a).to_pylist()])
                word_lang = np.repeat(number, w.count)
                at = w.gram_places()
                if not len(w.start):
                    continue
                word = np.minimum(np.searchsorted(w.start, at, "right") - 1 + (w.bytes[at] == 0x20), len(w.start) - 1)
                here = word_lang[np.maximum(word, 0)]
                for order in (0, *ORDERS):
                    if order:
                        joint, size = here * CELLS + w.cells[order][at], CELLS
                    else:
                        joint, size = word_lang[w.letter_word] * len(SCRIPTS) + w.letter_script, len(SCRIPTS)
                    n = np.bincount(joint, minlength=len(langs) * size).reshape(len(langs), size)
                    for k, lang in enumerate(langs):
                        if (lang, order) in total:
                            total[lang, order] += n[k]
                        else:
                            total[lang, order] = n[k].copy()
        for (lang, order), n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array([order] * len(used), pa.int32()),
                 pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["lang", "order", "cell", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    return rows.mapInArrow(returning(run), "lang string, order int, cell bigint, n bigint").groupBy("lang", "order", "cell").agg(
        F.sum("n").alias("n"))


class Model:
    """Log scores of n-gram cells and the scripts of every trained language."""

    def __init__(self, counts: pa.Table):
        lang = counts.column("lang").to_pylist()
        order, cell, n = (np.asarray(counts.column(c)) for c in ("order", "cell", "n"))
        letters: dict[str, int] = dict.fromkeys(lang, 0)
        for name, o, x in zip(lang, order.tolist(), n.tolist()):
            letters[name] += x if o == 0 else 0
        self.langs = sorted((x for x in letters if letters[x]), key=lambda x: (-letters[x], x))
        number = {x: k for k, x in enumerate(self.langs)}
        which = np.array([number.get(x, -1) for x in lang], np.int64)
        k = len(self.langs)
        self.score = {}
        for o in ORDERS:
            table, use = np.zeros((k, CELLS)), (order == o) & (which >= 0)
            table[which[use], cell[use]] = n[use]
            self.score[o] = np.log((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * CELLS)).astype(np.float32)
        used, use = np.zeros((k, len(SCRIPTS))), (order == 0) & (which >= 0)
        used[which[use], cell[use]] = n[use]
        share = used / np.maximum(used.sum(1, keepdims=True), 1)
        self.script = ((share >= SCRIPT_SHARE) * (1 << np.arange(len(SCRIPTS)))).sum(1).astype(np.int64)

    def words(self, w: Letters) -> np.ndarray:
        """Score of each word in each language relative to the best one; 0 for words that say
        nothing (no letters, or a script that no language uses)."""
        out = np.zeros((len(w.start), len(self.langs)), np.float32)
        if not len(w.start) or not len(self.langs):
            return out
        allowed = (w.script[:, None] & self.script[None, :]) != 0
        # a word's n-grams begin at the gap in front of it and end with its last letter
        cuts = np.stack([w.start - 1, w.end], 1).ravel()
        for k in range(len(self.langs)):
            part = sum(self.score[o][k][w.cells[o]] for o in ORDERS)
            out[:, k] = np.add.reduceat(np.append(part, np.zeros(4, np.float32)), cuts)[::2]
        out = np.where(allowed, out, -np.inf)
        best = out.max(1, keepdims=True)
        out = np.maximum(out - np.where(np.isfinite(best), best, 0), -SPREAD)
        out[~allowed] = -2 * SPREAD
        out[~allowed.any(1)] = 0
        return out


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; texts advance side by side, one word per step."""
    n, k = score.shape
    path, back = np.zeros(n, np.int16), np.zeros((n, k), np.int16)
    order = np.argsort(-count, kind="stable")
    alive = np.searchsorted(-count[order], -np.arange(count.max(initial=0) + 1), "left")  # texts with more than t words
    state, own = np.zeros((len(order), k), np.float32), np.arange(k, dtype=np.int16)
    for t in range(int(count.max(initial=0))):
        m = alive[t]
        at = first[order[:m]] + t
        prev = state[:m]
        if t:
            top = prev.argmax(1)
            other = prev[np.arange(m), top] - switch
            jump = other[:, None] > prev
            back[at] = np.where(jump, top[:, None], own)
            prev = np.where(jump, other[:, None], prev)
        state[:m] = prev + score[at]
    if len(order):
        now = state.argmax(1)
        for t in range(int(count.max(initial=0)) - 1, -1, -1):
            m = alive[t]
            at = first[order[:m]] + t
            path[at] = now[:m]
            now[:m] = back[at, now[:m]]
    return path


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of all letters that lie in spans of that language
    and in a script that a trained language uses) and, with ``spans``, ``lang_spans``: runs of words
    (counted from 0) with one label. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "lang_spans")
    added = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
             F.expr("cast(array() as array<struct<lang:string,first:int,last:int>>)").alias("lang_spans")][:3 if spans else 2]
    schema = docs.select("*", *added).schema
    text_at = docs.columns.index(text_col)

    def label(texts: list[str | None]) -> tuple[list, list, list]:
        w = Letters([t or "" for t in texts])
        path = viterbi(model.words(w), w.first[:-1], w.count, switch)
        useful = np.bitwise_or.reduce(model.script) >> w.letter_script & 1
        weight = np.bincount(w.letter_word, useful, len(w.start))
        text = np.repeat(np.arange(len(texts)), w.count)
        per = np.bincount(text * len(model.langs) + path, weight, len(texts) * len(model.langs)).reshape(len(texts), -1)
        top, total = per.argmax(1), np.bincount(text, w.letters, len(texts))
        share = per.max(1) / np.maximum(total, 1)
        head = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (text[1:] != text[:-1]))) if len(path) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(path)) - 1
        found: list[list[dict]] = [[] for _ in texts]
        base = w.first[:-1]
        for h, e, t, p in zip(head.tolist(), tail.tolist(), text[head].tolist(), path[head].tolist()) if spans else ():
            found[t].append({"lang": model.langs[p], "first": h - int(base[t]), "last": e - int(base[t])})
        said, score = [], []
        for k, t in enumerate(texts):
            letters = t is not None and _LETTER.search(t) is not None
            said.append(model.langs[top[k]] if letters else UND)
            score.append(float(share[k]) if letters else 0.0)
            if not letters:
                found[k] = []
        return said, score, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for a, b in slices(batch.column(text_at), SLICE):
                part = batch.slice(a, b - a)
                texts = part.column(text_at).to_pylist()
                said, score, found = label(texts) if model.langs else ([UND] * len(texts), [0.0] * len(texts), [[]] * len(texts))
                own = [pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(found, span)][:3 if spans else 2]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=schema.names)

    return docs.mapInArrow(returning(run), schema)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all labelled rows of ``docs``; its size is bounded per language."""
    return Model(train_counts(docs, lang_col, text_col).toArrow())


def predict_languages(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``, learnt from the rows that are not held out."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
    model = fit(rows.where(~held_out(F.col("doc_id"))))
    found = identify(rows.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
