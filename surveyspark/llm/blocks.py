"""Corpus-wide questions about 64-bit keys, asked and answered in packed form.

Documents are dealt into blocks of bounded size by a hash of id and text, so neither a hot
source nor a group of copies gathers in one block. A block sends its *distinct* keys, sorted
and cut into ranges (buckets); a key that a third of all rows share therefore reaches its
bucket once per block, not once per row. The answers come back to the block as one bit per key.
Both exchanges move arrays, and the texts are exchanged once: every step that needs them groups
the same frame by block, so Spark reuses the exchange.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.session import checkpoint_dir

BLOCK_BYTES = 4 << 20  # text bytes of a block

SENT = "block bigint, bucket bigint, keys binary, more binary"
FLAGS = "block bigint, bucket bigint, kind int, flags binary"


def count_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> int:
    """As many blocks, and as many buckets, as ``block_bytes`` per block ask for. Blocks times
    buckets rows are sent; beyond 16 GB blocks grow with the root of the corpus, so that a row
    always carries dozens of keys."""
    return block_plan(docs, text_col, block_bytes)[0]


def block_plan(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """The number of blocks and the text bytes of one."""
    size = int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint")).alias("n")).first()["n"] or 0)
    block_bytes = max(block_bytes, math.isqrt(1024 * size))
    return max(1, -(-size // block_bytes)), block_bytes


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside: a batch of whole texts is
    held by the JVM and by the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: cuts the lineage, and takes a
    fraction of the room of checkpoint(), which writes rows as they are."""
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``stored`` whose tables are removed at the end of the block: for what nothing lazy reads."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = _stored(df)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, n_blocks: int) -> DataFrame:
    """Adds ``block``; other columns stay."""
    return docs.withColumn("block", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Range of a key: ascending in the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def cut(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted keys touch, and the borders between them."""
    bucket = bucket_of(keys, n_buckets)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at], np.append(at, len(keys))


def send(block: int, keys: np.ndarray, n_buckets: int, *arrays: np.ndarray, bits: np.ndarray | None = None) -> pa.Table:
    """Rows of SENT for one block: sorted distinct keys, bucket by bucket. ``more`` holds the
    slices of ``arrays`` one after the other, or the packed ``bits``."""
    buckets, border = cut(keys, n_buckets)
    spans = list(zip(border[:-1], border[1:]))
    if bits is not None:
        more = [np.packbits(bits[a:b]).tobytes() for a, b in spans]
    else:
        more = [b"".join(x[a:b].tobytes() for x in arrays) for a, b in spans]
    return pa.table({
        "block": pa.array([block] * len(spans), pa.int64()),
        "bucket": pa.array(buckets, pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
        "more": pa.array(more, pa.binary()),
    })


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a bucket and the borders between the rows that brought them."""
    parts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    border = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), border


def reply(table: pa.Table, border: np.ndarray, flags: np.ndarray, kind: int) -> pa.Table:
    """Rows of FLAGS: one bit for every key of every row received."""
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"),
        "kind": pa.array([kind] * table.num_rows, pa.int32()),
        "flags": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(border[:-1], border[1:])], pa.binary()),
    })


def answered(flags: pa.Table, kind: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits that came back for the sorted distinct ``keys`` of a block."""
    out = np.zeros(len(keys), bool)
    buckets, border = cut(keys, n_buckets)
    span = {int(b): (int(x), int(y)) for b, x, y in zip(buckets, border[:-1], border[1:])}
    for bucket, k, bits in zip(*(flags.column(c).to_pylist() for c in ("bucket", "kind", "flags"))):
        if k == kind:
            a, b = span[bucket]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def occurs_elsewhere(sent: DataFrame, kind: int = 1) -> DataFrame:
    """FLAGS of keys that occur at least twice in the corpus; ``more`` of ``sent`` holds the
    bits of keys that occur more than once inside the block."""

    def run(table: pa.Table) -> pa.Table:
        keys, border = received(table)
        twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=int(n)) for m, n in
                                zip(table.column("more").to_pylist(), np.diff(border))] or [np.zeros(0, np.uint8)])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(heads, len(keys)))
        again = (n > 1) | (np.add.reduceat(twice[order].astype(np.int64), heads) > 0 if len(heads) else n > 1)
        flags = np.zeros(len(keys), bool)
        flags[order] = np.repeat(again, n)
        return reply(table, border, flags, kind)

    return sent.groupBy("bucket").applyInArrow(run, FLAGS)


def with_answers(blocked: DataFrame, flags: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table],
                 schema: str, flags_block: str = "block") -> DataFrame:
    """``fn(block, documents, flags)`` for every block."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        return fn(key[0].as_py(), docs, answers)

    return blocked.groupBy("block").cogroup(flags.groupBy(flags_block)).applyInArrow(run, schema)


def in_order(docs: pa.Table, *by: str) -> pa.Table:
    """A block's rows in a fixed order, however they arrived."""
    return docs.sort_by([(c, "ascending") for c in by]).combine_chunks()


def joined(parts: Iterable[np.ndarray], dtype) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
