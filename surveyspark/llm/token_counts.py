"""Token counts of the documents in flat, unindexed token files.

A file is nothing but token ids; documents end with an end-of-document id. Blocks of a file are
scanned in one array operation for that id, each block is summed up by (separators, tokens in
front of the first, tokens behind the last), and a prefix scan over those summaries carries the
open document and the document number across block borders. The scan has two levels (blocks
within a chunk, chunks within a file), so one file may hold any share of the data.

Edge cases: two separators in a row are a document of 0 tokens; tokens behind the last separator
are a last, unfinished document; an empty file or table gives no rows; a document may span any
number of blocks. ``write_blocks`` takes null texts as empty documents, repeated rows as
documents of their own, and ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark.llm.blocks import stored
from surveyspark.llm.bpe import load_ranks, tokenizer_path
from surveyspark.llm.words import slices

SEPARATOR = 50256  # free in the rank files
BLOCK_TOKENS = 1 << 17
CHUNK_BLOCKS = 4096

BLOCK = "file bigint, block bigint, data binary, ids binary"


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken",
                 separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every partition as one flat file, stored as a table in the shared checkpoint folder (so every later
    pass reads the same files): blocks of ``block_tokens`` 16-bit ids cut regardless of documents. ``ids`` names, in order, the documents whose separator is in the block (the file
    itself does not)."""
    import public_tokenizers

    path, pattern = tokenizer_path(tokenizer), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        file, block = TaskContext.get().partitionId(), 0
        encode = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
        waiting, names = np.zeros(0, np.uint16), np.zeros(0, np.int64)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, names, block
            while len(waiting) >= block_tokens or (last and len(waiting)):
                data, waiting = waiting[:block_tokens], waiting[block_tokens:]
                n = int(np.count_nonzero(data == separator))
                mine, names = names[:n], names[n:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary()),
                     pa.array([mine.tobytes()], pa.binary())], names=["file", "block", "data", "ids"])
                block += 1

        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                new = [np.array([*encode(t or ""), separator], np.uint16) for t in part.column(1).to_pylist()]
                waiting = np.concatenate([waiting, *new])
                names = np.concatenate([names, np.asarray(part.column(0).fill_null(np.iinfo(np.int64).min))])
                yield from cut(False)
        yield from cut(True)

    return stored(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, BLOCK))


def read_files(spark: SparkSession, path: str, item_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the flat files under ``path`` (each at most 2 GB): path, file, block, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = block_tokens * item_bytes
        for batch in batches:
            for name, file, content in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(0, len(content), step):
                    yield pa.RecordBatch.from_pylist([{"path": name, "file": file, "block": k // step, "data": content[k:k + step]}])

    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("file"), "content")
    return files.mapInArrow(run, "path string, file bigint, block bigint, data binary")


def _scanned(blocks: DataFrame, separator: int, dtype: str) -> DataFrame:
    """One summary per block; ``inner`` holds the lengths of the documents that lie between two
    separators of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(tokens == separator)
                rows.append((len(at), int(at[0]) if len(at) else len(tokens),
                             len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens),
                             (np.diff(at) - 1).astype(np.int32).tobytes()))
            n, head, tail, inner = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()),
                 pa.array(tail, pa.int64()), pa.array(inner, pa.binary()), batch.column(3)],
                names=["file", "block", "n", "head", "tail", "inner", "ids"])

    ids = F.col("ids") if "ids" in blocks.columns else F.lit(None).cast("binary")
    return blocks.select("file", "block", "data", ids.alias("ids")).mapInArrow(
        run, "file bigint, block bigint, n bigint, head bigint, tail bigint, inner binary, ids binary")


def _carried(rows: DataFrame, keys: list[str], order: str, n: str, tail: str) -> DataFrame:
    """Adds, over the rows of ``keys`` in ``order``: ``open`` (tokens open in front of the row),
    ``fresh`` (no separator in front of it), ``number`` (separators in front of it)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_part", F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).over(w))
    rows = rows.withColumn("_run", F.sum(tail).over(Window.partitionBy(*keys, "_part").orderBy(order)))
    return (rows.withColumn("open", F.coalesce(F.lag("_run").over(w), F.lit(0)))
            .withColumn("fresh", F.coalesce(F.lag("_part").over(w), F.lit(0)) == 0)
            .withColumn("number", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))


def count_documents(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "uint16",
                    chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Per document: ``file, number, n_tokens, finished, doc_id`` (doc_id null where the blocks name none)."""
    rows = _scanned(blocks, separator, dtype).withColumn("chunk", F.floor(F.col("block") / chunk_blocks))
    rows = _carried(rows, ["file", "chunk"], "block", "n", "tail")
    chunks = rows.groupBy("file", "chunk").agg(
        F.sum("n").alias("chunk_n"), F.max_by("_run", "block").alias("chunk_tail"))
    chunks = _carried(chunks, ["file"], "chunk", "chunk_n", "chunk_tail").select(
        "file", "chunk", F.col("open").alias("chunk_open"), F.col("number").alias("chunk_number"),
        F.lead("chunk").over(Window.partitionBy("file").orderBy("chunk")).isNull().alias("last_chunk"))
    rows = rows.join(chunks, ["file", "chunk"])
    last = F.lead("block").over(Window.partitionBy("file", "chunk").orderBy("block")).isNull() & F.col("last_chunk")
    rows = rows.select(
        "file", "n", "head", "inner", "ids", "tail",
        (F.col("open") + F.when(F.col("fresh"), F.col("chunk_open")).otherwise(0)).alias("open"),
        (F.col("number") + F.col("chunk_number")).alias("number"), last.alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = []
                if r["n"]:
                    ends = [r["open"] + r["head"], *np.frombuffer(r["inner"], np.int32).tolist()]
                done = [True] * len(ends)
                rest = r["tail"] if r["n"] else r["open"] + r["tail"]
                if r["last"] and rest:
                    ends, done = [*ends, rest], [*done, False]
                ids = np.frombuffer(r["ids"], np.int64).tolist() if r["ids"] is not None else []
                ids = [None if x == np.iinfo(np.int64).min else x for x in ids] + [None] * (len(ends) - len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * len(ends), pa.int64()), pa.array(range(r["number"], r["number"] + len(ends)), pa.int64()),
                     pa.array(ends, pa.int64()), pa.array(done, pa.bool_()), pa.array(ids, pa.int64())],
                    names=["file", "number", "n_tokens", "finished", "doc_id"])

    return rows.mapInArrow(run, "file bigint, number bigint, n_tokens bigint, finished boolean, doc_id bigint")
