"""Benchmark decontamination by greedy string tiling.

Shared seeds (``least`` tokens in a row) propose a document and a test item. The pair is tiled:
again and again the longest common stretch of tokens that no tile covers yet is marked on both
sides, found by running Karp-Rabin hashes, until nothing of ``least`` tokens is left. The share
of the item's tokens under tiles decides, so a passage whose sentences were reordered or
interrupted is still caught.

The items are cut into chunks of at most ``CHUNK_BYTES`` of text; a chunk's seeds are broadcast
and the documents are read once per chunk, so any number of items works the same way. Documents
are never shuffled.

Tokens: lower-cased runs of letters, digits and non-ASCII symbols; punctuation, white space (of
all Unicode) and ASCII symbols separate, and every character of a script written without spaces
is a token. Items with fewer than ``least`` tokens are met only when asked for (``short``, as the
query and the pipeline do): by a seed of their own length, so whole, with coverage 1. Edge cases:
null and empty texts hold nothing; very long texts are scanned whole; null items and those without
a token are never reported; equal items are reported each; ties between equally long stretches go to the earlier place in the document,
then in the item; empty tables give no reports; other columns ride along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import Family, Words, has_window, owner, returning, slices, window_hashes

LEAST = 5  # tokens of the shortest tile
COVERAGE = 0.5  # share of the item's tokens under tiles
CHUNK_BYTES = 16 << 20

LEAK = "struct<item_id:bigint,coverage:double,longest:int,tiles:int>"

_FAMILY = Family(31)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_GAP = r"[\p{Z}\p{P}\x{80}-\x{9F}]+"
_UNSPACED = "([%s\u30fc\uff70])" % "".join(r"\p{%s}" % x for x in (
    "Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Tai_Le",
    "New_Tai_Lue", "Tai_Tham", "Tai_Viet", "Balinese", "Javanese"))
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _windows(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of the stretches of ``size`` unmarked tokens."""
    drop, value, run = pow(_BASE, size - 1, _PRIME), 0, 0
    for k, token in enumerate(tokens):
        if not free[k]:
            value = run = 0
            continue
        if run >= size:
            value -= tokens[k - size] * drop
        value = (value * _BASE + token) % _PRIME
        run += 1
        if run >= size:
            yield k - size + 1, value


def tiling(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, start in text, start in item), longest first."""
    open_text, open_item = [True] * len(text), [True] * len(item)
    tiles, size = [], max(least, min(len(item), 32))
    while True:
        places = defaultdict(list)
        for q, h in _windows(item, open_item, size):
            places[h].append(q)
        found = []
        for p, h in _windows(text, open_text, size):
            for q in places.get(h, ()):
                n = 0
                while (p + n < len(text) and q + n < len(item) and open_text[p + n] and open_item[q + n]
                       and text[p + n] == item[q + n]):
                    n += 1
                if n >= size:
                    found.append((n, p, q))
        if not found:
            if size == least:
                return tiles
            size = max(least, size // 2)
            continue
        longest = max(n for n, _, _ in found)
        for n, p, q in found:
            if n == longest and all(open_text[p:p + n]) and all(open_item[q:q + n]):
                open_text[p:p + n] = [False] * n
                open_item[q:q + n] = [False] * n
                tiles.append((n, p, q))


class Seeds:
    """Tokens and seeds of one chunk of items; ``short``: tokens of shorter items -> their numbers, by length."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int, short: bool = False):
        self.least, self.ids = least, ids
        w, h = _tokens(pa.array(texts, pa.string()))
        self.items = [(h[a:b] % np.uint64(_PRIME)).tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        at = np.flatnonzero(has_window(w, least))
        keys = window_hashes(h, least, _FAMILY)[at]
        text = owner(w)[at]
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], text[order]
        self.place = (at - w.first[text])[order]
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, n in enumerate(w.count.tolist()):
            if short and 0 < n < least:
                self.short.setdefault(n, {}).setdefault(tuple(h[w.first[k]:w.first[k + 1]].tolist()), []).append(k)
        self.short_keys = {}
        for n, items in self.short.items():
            every = np.array(list(items), np.uint64).ravel()
            self.short_keys[n] = np.unique(window_hashes(every, n, _FAMILY)[::n])
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True


def _tokens(col: pa.Array) -> tuple[Words, np.ndarray]:
    col = pc.utf8_lower(col.cast(pa.large_string()))
    if not pc.all(pc.string_is_ascii(col), min_count=0).as_py():
        col = pc.replace_substring_regex(pc.replace_substring_regex(col, _UNSPACED, r" \1 "), _GAP, " ")
    w = Words(col, _FOLD)
    return w, w.hashes(_FAMILY)


def _leaks(col: pa.Array, seeds: Seeds, coverage: float) -> list[list[tuple[int, float, int, int]]]:
    """For every text of a slice: its items with enough of their tokens under tiles."""
    out: list[list] = [[] for _ in range(len(col))]
    w, h = _tokens(col)
    keys = window_hashes(h, seeds.least, _FAMILY)
    at = np.flatnonzero(seeds.filter[(keys >> np.uint64(42)).astype(np.int64)] & has_window(w, seeds.least))
    lo, hi = np.searchsorted(seeds.keys, keys[at], "left"), np.searchsorted(seeds.keys, keys[at], "right")
    at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
    text = np.searchsorted(w.first, at, "right") - 1
    met: dict[tuple[int, int], tuple[set, list]] = defaultdict(lambda: (set(), []))
    for t, p, a, b in zip(text.tolist(), at.tolist(), lo.tolist(), hi.tolist()):
        for k in range(a, b):
            places, where = met[t, int(seeds.item[k])]
            places.add(int(seeds.place[k]))
            if not where or where[-1] != p:
                where.append(p)
    for n, items in seeds.short.items():
        keys, known = window_hashes(h, n, _FAMILY), seeds.short_keys[n]
        at = np.flatnonzero(has_window(w, n))
        at = at[known[np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)] == keys[at]]
        text = np.searchsorted(w.first, at, "right") - 1
        _, one = np.unique(np.stack([text.astype(np.uint64), keys[at]]), axis=1, return_index=True)
        for t, p in zip(text[one].tolist(), at[one].tolist()):
            out[t] += [(seeds.ids[k], 1.0, n, 1) for k in items.get(tuple(h[p:p + n].tolist()), ())]
    for (t, item), (places, where) in sorted(met.items()):
        tokens = seeds.items[item]
        could = {q + k for q in places for k in range(seeds.least)}
        if len(could) < coverage * len(tokens):
            continue
        # only stretches under seeds can hold tiles; a gap stands between them
        near, last = [], -1
        for p in where:
            if last >= 0 and p > last:
                near.append(-1)
            near += [int(x) for x in h[max(p, last):p + seeds.least] % np.uint64(_PRIME)]
            last = p + seeds.least
        tiles = tiling(near, tokens, seeds.least)
        share = sum(n for n, _, _ in tiles) / len(tokens)
        if share >= coverage:
            out[t].append((seeds.ids[item], share, tiles[0][0], len(tiles)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE,
               chunk_bytes: int = CHUNK_BYTES, short: bool = True) -> DataFrame:
    """``docs`` with ``leaks``: the items found in each text; unless ``short`` is off, also those of fewer than
    ``least`` tokens, as a whole."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_chunks = max(1, -(-int(total) // chunk_bytes))
    out = docs.withColumn("leaks", F.expr(f"cast(array() as array<{LEAK}>)"))
    schema, text_at = out.schema, docs.columns.index(text_col)
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("longest", pa.int32()), ("tiles", pa.int32())]))
    names = [f.name for f in leak.value_type]
    for chunk in range(n_chunks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_chunks)) == chunk).orderBy("item_id", "text").toArrow()
        seeds = Seeds(mine.column("item_id").to_pylist(), mine.column("text").to_pylist(), least, short)

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(text_at)):
                    part = batch.slice(a, b - a)
                    new = [[dict(zip(names, x)) for x in found] for found in _leaks(part.column(text_at), seeds, coverage)]
                    before = part.column(part.num_columns - 1).to_pylist()
                    both = pa.array([x + y for x, y in zip(before, new)], leak)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], both], names=part.schema.names)

        out = out.mapInArrow(returning(run), schema)
    return out
