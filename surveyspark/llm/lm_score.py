"""Cross-entropy difference: how much more a document looks like the target than like the rest.

A target model (documents of the wanted label) and a background model (all documents) are
bigram models over one vocabulary, the ids of a public tokenizer plus a text border. The loss
of a token under a model is -log p(w | h) with p(w | h) = (c(h, w) + m p(w)) / (c(h) + m) and
p(w) = (c(w) + 1) / (N + V); a document's score is the mean over its tokens (and its end) of
target loss minus background loss: the lower, the closer to the target. A document is scored by
models that did not count it: its own counts are taken off both first, so being in the target
does not by itself bring it closer.

Counts cover all documents and are exact. Every text is tokenised once, into a stored table of ids
in the shared checkpoint folder. A block (some megabytes of texts of one task) sends each distinct
bigram and token once with its two counts, buckets add them up, and the sums go back to the blocks
that asked; nothing is gathered on the driver, no block holds more than its share however often
an id occurs, and a bigram that every document holds arrives once per block.

Edge cases: null and empty texts have 0 tokens and null losses; very long texts are scored
whole; repeated rows count as often as they occur (one row's own counts are taken off, not its
repeats'); of several labels of a document the largest decides; documents without a label or with a
null id are background only; an empty table gives an empty result; with no other target documents
the target model is uniform; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import blocks
from surveyspark.llm.bpe import TOKENIZER_FILE, load_ranks, tokenizer_path
from surveyspark.llm.words import slices
from surveyspark.operators.broadcast import small_side

BORDER = 50256  # beginning and end of a text
NONE = 0xFFFF  # history of a single token; (NONE, NONE) holds the number of all tokens
VOCABULARY = 50257
WEIGHT = 20.0  # pseudo-count of the unigram model in the bigram model
BLOCK_BYTES = 4 << 20

#: Rows of documents, and of what a block sends to a bucket.
TABLE = "block bigint, id bigint, target boolean, ids binary, bucket bigint, keys binary, more binary"
_EDGE = np.array([BORDER], np.uint16)
_SPREAD, _SHIFT = np.uint32(0x9E3779B1), np.uint64(32)


class Tokenizer:
    """The installed tokenizer, built once per worker."""

    made: dict = {}

    @classmethod
    def get(cls, path: str, pattern: str):
        if path not in cls.made:
            import tiktoken

            cls.made[path] = tiktoken.Encoding("lm", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        return cls.made[path]


def _events(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All (history, token) pairs as 32-bit keys, text after text, and the borders of the texts."""
    parts = [np.concatenate([_EDGE, x, _EDGE]).astype(np.uint32) for x in ids]
    size = np.array([len(p) - 1 for p in parts], np.int64)
    pairs = [p[:-1] << np.uint32(16) | p[1:] for p in parts]
    return blocks.joined(pairs, np.uint32), np.concatenate([[0], np.cumsum(size)])


def _own(pairs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each event, how often it occurs in its own text, and how often its history does."""
    keys = owner.astype(np.uint64) << _SHIFT | pairs
    order = np.argsort(keys)
    keys, out = keys[order], []
    for k in (keys, keys >> np.uint64(16)):
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(k)))
        own = np.empty(len(k), np.int64)
        own[order] = np.repeat(n, n)
        out.append(own)
    return out[0], out[1]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their numbers."""
    keys = np.sort(keys)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def _single(token: np.ndarray) -> np.ndarray:
    return np.uint32(NONE << 16) | token.astype(np.uint32)


ALL = np.array([0xFFFFFFFF], np.uint32)  # the event that counts all tokens


def _tally(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, single tokens and all tokens of some texts: spread keys (32 bits, not sorted) and counts."""
    two, n_two = _counted(pairs * _SPREAD)
    one = np.bincount(pairs & np.uint32(0xFFFF), minlength=1)
    used = np.flatnonzero(one)
    return np.concatenate([two, _single(used) * _SPREAD, ALL * _SPREAD]), np.concatenate([n_two, one[used], [len(pairs)]])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             label: str = "quality", wanted: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_tokens, target_loss, background_loss, score``."""
    import public_tokenizers

    path, pattern = tokenizer_path(TOKENIZER_FILE), public_tokenizers.PATTERN
    n, slice_bytes = blocks.block_plan(docs, text_col, block_bytes)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    target = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("wanted"))
              .agg(F.max(label).alias("label")).where(F.col("label") == wanted).select("wanted"))
    rows = rows.join(small_side(target), F.col("id") == F.col("wanted"), "left")
    rows = rows.select("id", "text", F.col("wanted").isNotNull().alias("target"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, block = Tokenizer.get(path, pattern).encode_ordinary, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end in slices(batch.column(1), slice_bytes):
                part = batch.slice(at, end - at)
                ids = [np.array(encode(t) if t else [], np.uint16) for t in part.column(1).to_pylist()]
                yield _row(len(ids), block=np.full(len(ids), block), id=part.column(0), target=part.column(2),
                           ids=[x.tobytes() for x in ids])
                yield sent(block, ids, np.asarray(part.column(2)))
                block += 1

    def sent(block: int, ids: list[np.ndarray], mine: np.ndarray) -> pa.RecordBatch:
        pairs, border = _events(ids)
        half, all_ = _tally(pairs)  # the odd factor deals them evenly to buckets
        order = np.argsort(half)
        half, all_ = half[order], all_[order]
        some = np.zeros(len(half), np.int64)
        keys, n_some = _tally(pairs[np.repeat(mine, np.diff(border))])
        some[np.searchsorted(half, keys)] = n_some
        buckets, edge = blocks.cut(half.astype(np.uint64) << _SHIFT, n)
        spans = list(zip(edge[:-1], edge[1:]))
        return _row(len(spans), block=np.full(len(spans), block), bucket=buckets, keys=[half[a:b].tobytes() for a, b in spans],
                    more=[all_[a:b].astype(np.uint32).tobytes() + some[a:b].astype(np.uint32).tobytes() for a, b in spans])

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        both = [np.frombuffer(m, np.uint32).reshape(2, -1) for m in table.column("more").to_pylist()]
        edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        _, where = np.unique(blocks.joined(keys, np.uint32), return_inverse=True)
        both = np.concatenate(both, axis=1) if both else np.zeros((2, 0))
        total = [np.bincount(where, x)[where] if len(where) else x for x in both]  # float64: exact up to 2^53
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([1] * table.num_rows, pa.int32()),
            "flags": pa.array([np.stack([t[a:b] for t in total]).astype(np.int64).tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    def score(_: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, border = _events([np.frombuffer(x, np.uint16) for x in docs.column("ids").to_pylist()])
        got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist()))
        sums = [np.frombuffer(f, np.int64).reshape(2, -1) for _, f in got]
        sums = np.concatenate(sums, axis=1) if sums else np.zeros((2, 0), np.int64)
        size = np.diff(border)
        owner = np.repeat(np.arange(len(size)), size)
        token = pairs & np.uint32(0xFFFF)
        # the same distinct keys in the same order as they were sent
        keys = np.sort(_tally(pairs)[0])
        two, which = np.unique(pairs, return_inverse=True)
        pair_at = np.searchsorted(keys, two * _SPREAD)[which]
        of_token = np.searchsorted(keys, _single(np.arange(VOCABULARY)) * _SPREAD)  # for tokens that occur
        token_at, all_at = of_token[token], np.searchsorted(keys, ALL * _SPREAD)
        before_at = of_token[pairs >> np.uint32(16)]
        pair_own, before_own = _own(pairs, owner)
        token_own = np.append(before_own[1:], 1)  # a token is the next event's history,
        token_own[border[1:] - 1] = 1  # but for the border at the end
        own = (pair_own, token_own, before_own, size[owner])
        loss = []
        for c, counted in zip(sums[::-1], (np.asarray(docs.column("target").combine_chunks())[owner], True)):  # target, background
            pair, word, before, total = (x - counted * y for x, y in zip((c[pair_at], c[token_at], c[before_at], c[all_at[0]]), own))
            loss.append(-np.log((pair + WEIGHT * (word + 1) / (total + VOCABULARY)) / (before + WEIGHT)))
        upto = [np.concatenate([[0.0], np.cumsum(x)]) for x in loss]
        mean = [(u[border[1:]] - u[border[:-1]]) / size for u in upto]
        empty = size <= 1
        col = lambda x: pa.array(x, pa.float64(), mask=empty)
        return pa.table({"doc_id": docs.column("id"), "n_tokens": pa.array(size - 1, pa.int64()), "target_loss": col(mean[0]),
                         "background_loss": col(mean[1]), "score": col(mean[0] - mean[1])})

    table = blocks.stored(rows.mapInArrow(encoded, TABLE))
    sums = table.where("bucket is not null").select("block", "bucket", "keys", "more").groupBy("bucket").applyInArrow(add_up, blocks.FLAGS)
    texts = table.where("bucket is null").select("block", "id", "target", "ids")
    out = blocks.with_answers(texts, sums.withColumnRenamed("block", "to"), score,
                              "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double", "to")
    return out.withColumnRenamed("doc_id", id_col)


def _row(n: int, **columns) -> pa.RecordBatch:
    """A batch of TABLE; columns not given are null."""
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split(" ") for f in TABLE.split(", ")]
    own = [x if isinstance(x := columns.get(f, pa.nulls(n, kinds[k])), pa.Array) else pa.array(x, kinds[k]) for f, k in fields]
    return pa.RecordBatch.from_arrays(own, names=[f for f, _ in fields])
