"""Substring dedup over difference-cover anchors.

A repeated passage is found from few hashed places: with period ``v`` and a perfect difference
cover ``D`` of it, any two places i, j have a shift s < v with (i + s) mod v and (j + s) mod v
both in D. So two equal windows of ``width`` words always share an anchor (the
``width - v + 1`` words at such a place) at the same shift, although only |D|/v of all places
are hashed. Anchors that occur twice in the corpus are extended to the full windows around
them; of those, every occurrence but the earliest (by document id, then start) is marked, and
the words under marked windows go.

Two rounds of packed questions (``blocks``): which anchors occur twice; which windows are not
the earliest of their kind. Anchor keys have 64 bits and only propose; windows are compared by
64 + 32 bits.

Edge cases: a null or wordless text has 0 words and an empty kept text; a text shorter than a
window loses nothing; very long texts are cut into slices for tokenizing only by rows, never
inside a text; of rows with equal (doc_id, start) none is earlier than the other, so rows with
the same id never remove each other at the same place; a null doc_id counts as the largest;
other columns ride along, whatever their names (``block`` excepted, which is replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import blocks
from surveyspark.llm.words import Family, Words, has_window, slices, window_hashes

WIDTH = 20
PERIOD, COVER = 7, (0, 1, 3)  # a perfect difference cover: every shift mod 7 is a difference of two members

_ONE, _TWO = Family(11), Family(12)
_LAST_ID = np.iinfo(np.int64).max

OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


class _Block:
    """Words, anchors and windows of the documents of one block, in (id, text) order."""

    def __init__(self, docs: pa.Table, width: int, cover: tuple, period: int):
        self.docs = blocks.in_order(docs, "id", "text")
        text, self.width = self.docs.column("text").combine_chunks(), width
        ids = np.asarray(self.docs.column("id").combine_chunks().fill_null(_LAST_ID))
        self.spans = list(slices(text))
        self.words = [Words(text.slice(a, b - a)) for a, b in self.spans]
        span = width - period + 1
        is_cover = np.isin(np.arange(period), cover)
        one, doc, place, anchor_at, whole = [], [], [], [], []
        for (a, b), w in zip(self.spans, self.words):
            h = w.hashes(_ONE)
            start = np.arange(len(h)) - np.repeat(w.first[:-1], w.count)
            anchor_at.append(has_window(w, span) & is_cover[start % period])
            whole.append(has_window(w, width))
            one.append((window_hashes(h, span, _ONE), window_hashes(h, width, _TWO)))
            doc.append(np.repeat(ids[a:b], w.count))
            place.append(start)
        self.anchor_hash = blocks.joined((x for x, _ in one), np.uint64)
        self.window_hash = blocks.joined((y for _, y in one), np.uint64)
        self.doc, self.place = blocks.joined(doc, np.int64), blocks.joined(place, np.int64)
        self.anchor_at, self.whole = blocks.joined(anchor_at, bool), blocks.joined(whole, bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor keys, where each anchor stands among them, how often each occurs."""
        return np.unique(self.anchor_hash[self.anchor_at], return_inverse=True, return_counts=True)

    def extended(self, repeated: np.ndarray, period: int) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor at a shift below the period."""
        near = np.zeros(len(self.whole) + period, np.int64)
        near[np.flatnonzero(self.anchor_at)[repeated]] = 1
        upto = np.concatenate([[0], np.cumsum(near)])
        return np.flatnonzero((upto[period:len(self.whole) + period] > upto[:len(self.whole)]) & self.whole)

    def check_hash(self, at: np.ndarray) -> np.ndarray:
        """A second hash of the windows, from word hashes of another family."""
        out, base = np.zeros(len(self.whole), np.uint32), 0
        for w in self.words:
            n = len(w.start)
            if np.any((at >= base) & (at < base + n)):
                out[base:base + n] = window_hashes(w.hashes(_TWO), self.width, _ONE) >> np.uint64(32)
            base += n
        return out[at]


def _first_of_kind(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in (id, start) order: the first entry of each kind, sorted by key, and the
    number of its kind for every entry."""
    order = np.lexsort((np.arange(len(keys)), check, keys))
    k, c = keys[order], check[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    kind = np.empty(len(keys), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def _not_earliest(sent: DataFrame, kind: int) -> DataFrame:
    """FLAGS of windows whose words start earlier in another block. ``more``: check hash,
    document and start of the earliest window of the kind in the block."""

    def run(table: pa.Table) -> pa.Table:
        keys, border = blocks.received(table)
        check, doc, start = [], [], []
        for more, n in zip(table.column("more").to_pylist(), np.diff(border).tolist()):
            check.append(np.frombuffer(more, np.uint32, n))
            doc.append(np.frombuffer(more, np.int64, n, 4 * n))
            start.append(np.frombuffer(more, np.int32, n, 12 * n))
        check, doc, start = (blocks.joined(x, t) for x, t in ((check, np.uint32), (doc, np.int64), (start, np.int32)))
        order = np.lexsort((start, doc, check, keys))
        k, c, d, s = keys[order], check[order], doc[order], start[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.zeros(0, np.int64)
        flags = np.zeros(len(keys), bool)
        flags[order] = (d != d[head]) | (s != s[head])
        return blocks.reply(table, border, flags, kind)

    return sent.groupBy("bucket").applyInArrow(run, blocks.FLAGS)


def _kept_text(w: Words, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, per text of a slice."""
    stay = np.flatnonzero(~gone)
    size = (w.end - w.start)[stay] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    src = np.arange(to[-1]) + np.repeat(w.start[stay] - to[:-1], size)
    out = np.append(w.data, np.uint8(0x20))[src]
    out[to[1:] - 1] = 0x20
    upto = np.concatenate([[0], np.cumsum(~gone)])[w.first]  # kept words before each text
    per_text = np.diff(upto)
    has = per_text > 0
    keep = np.ones(len(out), bool)
    keep[to[upto[1:][has]] - 1] = False  # no space behind the last word of a text
    offsets = to[upto] - np.concatenate([[0], np.cumsum(has)])
    data = out[keep].tobytes()
    return pa.LargeStringArray.from_buffers(len(per_text), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                   width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                   block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256, kept`` and the ``carry`` columns."""
    if not {(a - b) % period for a in cover for b in cover} >= set(range(period)):
        raise ValueError("cover is no difference cover of the period")
    if width < period:
        raise ValueError("the window must be at least one period wide")
    n = blocks.count_blocks(docs, text_col, block_bytes)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    rows = blocks.in_blocks(rows, "id", "text", n)

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        keys, _, times = _Block(table, width, cover, period).anchors()
        return blocks.send(key[0].as_py(), keys, n, bits=times > 1)

    def candidates(block: _Block, flags: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, where, _ = block.anchors()
        at = block.extended(blocks.answered(flags, 1, keys, n)[where], period)
        check = block.check_hash(at)
        first, kind = _first_of_kind(block.window_hash[at], check)
        return at, check, first, kind

    def windows(number: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        block = _Block(table, width, cover, period)
        at, check, first, _ = candidates(block, flags)
        here = at[first]
        return blocks.send(number, block.window_hash[here], n, check[first], block.doc[here],
                           block.place[here].astype(np.int32))

    def kept(number: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        block = _Block(table, width, cover, period)
        at, _, first, kind = candidates(block, flags)
        here = at[first]
        # a kind's answer is about its first window; the later ones of the block go anyway
        later = blocks.answered(flags, 2, block.window_hash[here], n)
        gone = later[kind]
        gone |= (block.doc[at] != block.doc[here][kind]) | (block.place[at] != block.place[here][kind])
        under = np.zeros(len(block.whole) + width + 1, np.int64)
        np.add.at(under, at[gone], 1)
        np.add.at(under, at[gone] + width, -1)
        under = np.cumsum(under)[:len(block.whole)] > 0
        parts, total, removed, base = [], [], [], 0
        for w in block.words:
            g = under[base:base + len(w.start)]
            base += len(w.start)
            parts.append(_kept_text(w, g))
            total.append(w.count)
            removed.append(np.diff(np.concatenate([[0], np.cumsum(g)])[w.first]))
        text = pa.chunked_array(parts, pa.large_string())
        digest = [hashlib.sha256(t.as_buffer()).hexdigest() for t in text]
        out = {"doc_id": block.docs.column("id"),
               "n_words": pa.array(blocks.joined(total, np.int64).astype(np.int64)),
               "n_removed": pa.array(blocks.joined(removed, np.int64).astype(np.int64)),
               "kept_sha256": pa.array(digest, pa.string()), "kept": text.cast(pa.string())}
        return pa.table(out | {f"carry_{i}": block.docs.column(f"carry_{i}") for i in range(len(carry))})

    repeated = blocks.occurs_elsewhere(rows.groupBy("block").applyInArrow(anchors, blocks.SENT), kind=1)
    later = _not_earliest(blocks.with_answers(rows, repeated, windows, blocks.SENT), kind=2)
    kinds = dict(docs.dtypes)
    schema = ", ".join([OUT, *[f"carry_{i} {kinds[c]}" for i, c in enumerate(carry)]])
    out = blocks.with_answers(rows, repeated.unionByName(later), kept, schema)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept",
                      *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
