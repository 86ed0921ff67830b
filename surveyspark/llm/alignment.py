"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The ends of the tokens (byte offsets) of both tokenizers are two ascending lists. The shorter list
drives a galloping intersection: from the place reached in the longer list, steps of 1, 2, 4, ...
find a range that must hold the next end, and a binary search finds the place in it (many texts
side by side, one lane each). Ends in both
lists cut the tokens into groups; the differences of neighbouring places are the ranges of tokens
of the longer list that overlap each token of the shorter one: the links.

Both tokenizers always cut in front of a single space between two characters that are no white
space, and see the text behind it as one that follows a space. So texts fall into parts at such
spaces, and equal parts are encoded and aligned once per worker look-up (of bounded size).

How often a pair of ids is linked is counted in documents, over the whole corpus: every block of
texts sends each pair with its number of documents, sums and the best sum of every id of A (at most
as many rows as A has ids) are joined back to the pairs, and blocks read the answers for their
parts. Encoded blocks are a stored table in the shared checkpoint folder.

Edge cases: null and empty texts, and texts whose tokens do not spell the space and the text
exactly, have no tokens: zeros and an empty string; rows that repeat an id are documents of their
own; a null id stays null; special tokens' strings are plain text; an empty table gives an empty
result; other columns are ignored, whatever their names. A part without such a space in it (a
script without spaces, a long run) is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.blocks import in_order, joined, stored
from surveyspark.llm.bpe import _Seen
from surveyspark.llm.words import slices

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20  # text bytes of a block
PARTS_SEEN = 1 << 17  # parts that a worker looks up
BEYOND = "\u0530"  # Latin, Greek and Cyrillic letters stand below, which all pattern engines class alike

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")

DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string"
#: Rows of documents (their parts by number), of blocks (the pairs of every part) and of pairs.
TABLE = f"block bigint, id bigint, {DOCUMENT}, parts binary, sizes binary, links binary, pair bigint, docs bigint"


def gallop(ends: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each lane the first place from ``at`` on whose end is ``value`` or more; ``ends`` is ascending
    and holds such an end behind every ``at``."""
    low, high, step, last = at.copy(), at.copy(), 1, len(ends) - 1
    open_ = np.flatnonzero(ends[high] < value)
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, last)
        step *= 2
        open_ = open_[ends[high[open_]] < value[open_]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = ends[middle] < value[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def overlaps(driver: np.ndarray, first: np.ndarray, other: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many texts side by side, ``driver[first[k]:first[k + 1]]`` against ``other`` from place ``at[k]``
    on: the range (first, last) of places of ``other`` that each token of ``driver`` overlaps, and whether
    its end is an end of ``other``. A text's lists end at the same offset, offsets ascend over all texts."""
    low, high, common = (np.zeros(len(driver), kind) for kind in (np.int64, np.int64, bool))
    order = np.argsort(first[:-1] - first[1:], kind="stable")  # the longest first, so lanes end one by one
    size, here, at = np.diff(first)[order], first[:-1][order], at[order].copy()
    for k in range(int(size.max(initial=0))):
        lanes = int(np.searchsorted(-size, -k, "left"))
        token = here[:lanes] + k
        place = gallop(other, driver[token], at[:lanes])
        low[token], high[token], common[token] = at[:lanes], place, other[place] == driver[token]
        at[:lanes] = place + common[token]
    return low, high, common


def align(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of many texts (place of A's token, place of B's token), text by text, and whether the end of
    each token of A, and of B, is an end of the other. The shorter list of every text drives."""
    swap = np.diff(first_b) < np.diff(first_a)
    links, is_cut = [], [np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)]
    for turned in (False, True):
        mine = swap == turned
        driver, first, other, begin = (ends_b, first_b, ends_a, first_a) if turned else (ends_a, first_a, ends_b, first_b)
        size = np.diff(first)[mine]
        border = np.concatenate([[0], np.cumsum(size)])
        token = np.repeat(first[:-1][mine] - border[:-1], size) + np.arange(int(border[-1]))
        low, high, common = overlaps(driver[token], border, other, begin[:-1][mine])
        is_cut[turned][token] = common
        is_cut[not turned][high[common]] = True
        reach = high - low + 1
        far = np.repeat(low - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        near = np.repeat(token, reach)
        links.append(np.stack([far, near] if turned else [near, far], 1))
    pairs = np.concatenate(links)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[:, 0], pairs[:, 1], *is_cut


def byte_level() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the alignment of text parts already seen."""

    made: dict[tuple[str, str], Pair] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_level()
        spelt = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        self.spelt = [pa.array(x, pa.binary()) for x in (self.bytes_a, self.bytes_b)]
        self.length = [np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b)]
        # an id as text with what follows it: inside a group, at the end of a group
        self.said = pa.array([f"{i}{mark}" for x, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for mark in marks for i in range(len(x))])
        self.ranked = self._ranked(spelt)
        self.seen = _Seen(PARTS_SEEN)

    @classmethod
    def get(cls, path_a: str, path_b: str) -> Pair:
        if (path_a, path_b) not in cls.made:
            cls.made[path_a, path_b] = cls(path_a, path_b)
        return cls.made[path_a, path_b]

    def _ranked(self, spelt: dict[int, bytes]):
        """A as an encoding by ranks, which is several times faster, or None. It is the same if every
        merge makes a new token and later merges make higher ids: then of all neighbours that spell a
        token, those that the merges name are met first."""
        import public_tokenizers
        import tiktoken

        made = json.loads(self.a.to_str())
        ids = {t: i for i, t in spelt.items()}
        byte_of = byte_level()
        merged = [ids.get(bytes(byte_of[c] for x in (m if isinstance(m, list) else m.split(" ")) for c in x)) for m in made["model"]["merges"]]
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = made["normalizer"] is None and bytewise.items() <= made["pre_tokenizer"].items()
        ascending = None not in merged and all(x < y for x, y in zip(merged, merged[1:])) and len(ids) == len(merged) + 256
        if not (plain and ascending and all(bytes([b]) in ids for b in range(256))):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for a space and each part, ids of B for each part."""
        out, rest = [None] * len(parts), range(len(parts))
        if self.ranked is not None:
            rest = [k for k, p in enumerate(parts) if max(p) >= BEYOND]
            out = [self.ranked(" " + p) if max(p) < BEYOND else None for p in parts]
        for k, e in zip(rest, self.a.encode_batch_fast([" " + parts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out, self.b.encode(parts, num_threads=1)

    def _spells(self, which: int, ids: np.ndarray, first: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """For each text: do its tokens spell it?"""
        data = self.spelt[which].take(pa.array(ids))
        edge = np.frombuffer(data.buffers()[1], np.int32)[:len(ids) + 1][first] if len(ids) else np.zeros(len(first), np.int32)
        data = (data.buffers()[2].to_pybytes() if data.buffers()[2] else b"")[:int(edge[-1])]
        if data == b"".join(texts) and np.array_equal(np.diff(edge), [len(t) for t in texts]):
            return np.ones(len(texts), bool)
        return np.array([data[a:b] == t for a, b, t in zip(edge[:-1], edge[1:], texts)], bool)

    def _new(self, parts: set[str]):
        order = sorted(parts)
        texts = [b" " + p.encode() for p in order]
        ids, first = [], []
        for x in self.encode(order):
            ids.append(np.fromiter(chain.from_iterable(x), np.int64))
            first.append(np.concatenate([[0], np.cumsum([len(i) for i in x], dtype=np.int64)]))
        spells = self._spells(0, ids[0], first[0], texts) & self._spells(1, ids[1], first[1], texts)
        for k in (0, 1):  # the others have no tokens
            size = np.diff(first[k])
            ids[k] = ids[k][np.repeat(spells, size)]
            first[k] = np.concatenate([[0], np.cumsum(np.where(spells, size, 0))])
        ends = [np.cumsum(self.length[k][ids[k]]) for k in (0, 1)]
        at_a, at_b, cut_a, cut_b = align(ends[0], first[0], ends[1], first[1])
        links = (ids[0][at_a] << 32 | ids[1][at_b]).tobytes()
        link_edge = np.searchsorted(at_a, first[0]) * 8
        # the groups as text: every token of A stands behind the tokens of B of earlier groups, and so on
        group_a, group_b = (np.cumsum(c) - c for c in (cut_a, cut_b))
        place_a = np.arange(len(ids[0])) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(ids[1])) + np.searchsorted(group_a, group_b, "right")
        text = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        text[place_a] = ids[0] + cut_a * len(self.bytes_a)
        text[place_b] = ids[1] + 2 * len(self.bytes_a) + cut_b * len(self.bytes_b)
        said = self.said.take(pa.array(text))
        edge = np.frombuffer(said.buffers()[1], np.int32)[:len(text) + 1][first[0] + first[1]] if len(text) else np.zeros(len(order) + 1, int)
        groups = said.buffers()[2].to_pybytes().decode("ascii") if len(text) else ""
        n = [np.diff(first[0]).tolist(), np.diff(first[1]).tolist(), np.diff(np.concatenate([[0], np.cumsum(cut_a)])[first[0]]).tolist()]
        edge, link_edge = edge.tolist(), link_edge.tolist()
        return ((p, (n[0][k], n[1][k], n[2][k], groups[edge[k]:edge[k + 1] - 1], links[link_edge[k]:link_edge[k + 1]]) if ok else None)
                for k, (p, ok) in enumerate(zip(order, spells.tolist())))

    def parts(self, parts: list[str]) -> list:
        """For each part None, if its tokens do not spell it, or (tokens of A, of B, groups, the groups
        as text, the linked pairs of ids as 64-bit numbers)."""
        return list(map(self.seen.learn(set(parts), self._new).__getitem__, parts))

    def forget(self) -> None:
        """A worker that waits for another task holds no memory for its look-up."""
        self.seen = _Seen(PARTS_SEEN)


def _block(number: int, ids: pa.Array, texts: list[str], pair: Pair, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one block."""
    cut = [_SAFE_SPACE.split(t) if t else [] for t in texts]
    size = np.array([len(c) for c in cut], np.int64)
    flat = pa.array([p for c in cut for p in c], pa.string()).dictionary_encode()
    which = flat.indices.to_numpy().astype(np.int32)
    of_part = pair.parts(flat.dictionary.to_pylist())
    owner = np.repeat(np.arange(len(texts)), size)
    bad = np.array([x is None for x in of_part], bool)
    spoilt = np.bincount(owner, bad[which], len(texts)) > 0  # documents without tokens after all
    stay = ~spoilt[owner]
    which, owner = which[stay], owner[stay]
    size = np.where(spoilt, 0, size)
    upto = np.concatenate([[0], np.cumsum(size)])
    of_part = [x or (0, 0, 0, "", b"") for x in of_part]
    counts = [np.bincount(owner, np.array([x[k] for x in of_part], np.int64)[which], len(texts)).astype(np.int64) for k in range(3)]
    said = [x[3] for x in of_part]
    groups = [";".join(map(said.__getitem__, which[a:b].tolist())) for a, b in zip(upto[:-1], upto[1:])]

    links = np.frombuffer(b"".join([x[4] for x in of_part]), np.int64)
    sizes = np.array([len(x[4]) // 8 for x in of_part], np.int64)
    n_links = np.bincount(owner, sizes[which], len(texts)).astype(np.int64)
    pairs, at = np.unique(links, return_inverse=True)
    # documents that hold a pair: each (document, part) once, then each (document, pair) once
    once = np.unique(owner * np.int64(max(1, len(sizes))) + which)
    doc, part = np.divmod(once, max(1, len(sizes)))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    reach = sizes[part]
    inside = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
    held = np.unique(np.repeat(doc, reach) * np.int64(max(1, len(pairs))) + at[np.repeat(begin[part], reach) + inside])
    docs = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))

    sha = hashlib.sha256
    rows = {
        "block": pa.array(np.full(len(texts), number), pa.int64()), "id": ids, "n_a": pa.array(counts[0]), "n_b": pa.array(counts[1]),
        "n_groups": pa.array(counts[2]), "n_links": pa.array(n_links),
        "groups_sha256": pa.array([sha(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
        "groups": pa.array(groups if with_groups else [None] * len(texts), pa.string()),
        "parts": pa.array([which[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])], pa.binary()),
    }
    yield _padded(rows, len(texts))
    yield _padded({"block": pa.array([number], pa.int64()), "sizes": pa.array([sizes.astype(np.int32).tobytes()], pa.binary()),
                   "links": pa.array([at.astype(np.int32).tobytes()], pa.binary())}, 1)
    yield _padded({"block": pa.array(np.full(len(pairs), number), pa.int64()), "pair": pa.array(pairs, pa.int64()),
                   "docs": pa.array(docs, pa.int64())}, len(pairs))


_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _padded(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    fields = [f.split(" ") for f in TABLE.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(n, _TYPES[kind])) for f, kind in fields], names=[f for f, _ in fields])


def align_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
                path_b: str | None = None, with_groups: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with
    ``with_groups``, ``groups`` (ids of A and B, ``a1,a2|b1;a3|b2``). A link's count is the number of
    documents in which its two ids are linked somewhere; ``n_best`` links have the highest count of
    their id of A, ``count_sum`` adds the counts up."""
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path(FILE_A), path_b or public_tokenizers.path(FILE_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, number = Pair.get(str(path_a), str(path_b)), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end in slices(batch.column(1), block_bytes):
                part = batch.slice(at, end - at)
                yield from _block(number, part.column(0), part.column(1).to_pylist(), pair, with_groups)
                number += 1
        pair.forget()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    table = stored(rows.mapInArrow(run, TABLE))

    asked = table.where("pair is not null").select("block", "pair", "docs")
    total = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = F.shiftright("pair", 32)
    best = total.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # at most a row per id of A
    total = total.join(F.broadcast(best), of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.join(total, "pair").select(F.col("block").alias("to"), "pair", "n", "best")

    def finish(_: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = in_order(answers, "pair")
        n, is_best = (np.asarray(answers.column(c).combine_chunks()).astype(np.int64) for c in ("n", "best"))
        of_block = docs.filter(pc.is_valid(docs.column("sizes")))
        sizes, links = (np.frombuffer(of_block.column(c)[0].as_py(), np.int32) for c in ("sizes", "links"))
        edge = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

        def per_part(x: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(x[links])])
            return upto[edge[1:]] - upto[edge[:-1]]

        docs = docs.filter(pc.is_valid(docs.column("parts")))
        parts = [np.frombuffer(p, np.int32) for p in docs.column("parts").to_pylist()]
        border = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        which = joined(parts, np.int32)

        def per_doc(x: np.ndarray) -> pa.Array:
            upto = np.concatenate([[0], np.cumsum(per_part(x)[which])])
            return pa.array((upto[border[1:]] - upto[border[:-1]]).astype(np.int64), pa.int64())

        return docs.select(["id", *names]).append_column("n_best", per_doc(is_best)).append_column("count_sum", per_doc(n))

    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    texts = table.where("pair is null").drop("pair", "docs")
    out = (texts.groupBy("block").cogroup(answers.groupBy("to"))
           .applyInArrow(finish, f"id bigint, {DOCUMENT}, n_best bigint, count_sum bigint"))
    out = out if with_groups else out.drop("groups")
    return out.withColumnRenamed("id", id_col)
