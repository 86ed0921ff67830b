r"""Records of large text files whose separator may stand inside quoted text.

A file is read in byte splits and cut at every separator, quoted or not. What a piece does to the
reader's state (outside or inside quotes) is a map of two states: it keeps the state, flips it, or
sets it. Maps are put together in two levels: along the pieces of a split, which a task reads in
their order, then along the splits of a file on a table of one row per split. With the state that
enters a split known, a second reading numbers the records and joins the pieces of those that lie
in one split; only what a split's border cuts is put together by record number. So one file is read
by as many tasks as it has splits, no text is shuffled but that of cut records, and no task holds
more than a batch of pieces and one record of its split.

Edge cases: an empty file has no records; blank lines of CSV files are skipped and not counted; text behind the last separator is a record; an unclosed quote runs to the end of its file, as one
record. Text is UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.broadcast import stored

CSV_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
#: Does a line that begins outside (inside) quotes end inside them? A quote opens at a field's start only.
CSV_OPENS = rf'\A(?:{CSV_FIELD},)*+"(?:[^"]++|"")*+\z'
CSV_STAYS = rf'\A(?:[^"]++|"")*+(?:"[^,]*+,(?:{CSV_FIELD},)*+"(?:[^"]++|"")*+)?\z'

JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
JSON_OPENS = rf'(?s)\A(?:[^"]++|{JSON_STRING})*+"(?:[^"\\]++|\\.)*+\z'
JSON_STAYS = rf'(?s)\A(?:[^"\\]++|\\.)*+(?:"(?:[^"]++|{JSON_STRING})*+"(?:[^"\\]++|\\.)*+)?\z'


def read_records(spark: SparkSession, path: str, separator: str, opens: str, stays: str, blank: str = "(?!)") -> DataFrame:
    """``(file, record_no, text)``: records numbered from 0 per file, without the separator that ends them.
    ``opens`` (``stays``): pattern of a piece that ends inside quotes if it begins outside (inside) them;
    ``blank``: pattern of pieces to skip outside quotes. The records are stored."""
    quoted = F.contains("text", F.lit('"'))
    d = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.col("value").alias("text"))
    d = d.select("file", "_split", "text", (quoted & F.rlike("text", F.lit(opens))).alias("_o"),
                 (~quoted | F.rlike("text", F.lit(stays))).alias("_i"), (~F.rlike("text", F.lit(blank))).alias("_says"))
    ends = d.drop("text").mapInArrow(_ends, "file string, _split bigint, e0 boolean, e1 boolean, t0 bigint, t1 bigint")
    # one row per split, as the scan's own list of tasks; broadcast, which leaves the pieces in their order
    entering = F.broadcast(_entering(ends).withColumnsRenamed({"file": "_file", "_split": "_at"}))
    same = (F.col("file") == F.col("_file")) & (F.col("_split") == F.col("_at"))
    found = d.join(entering, same).drop("_file", "_at").mapInArrow(
        lambda batches: _records(batches, separator), "file string, record_no bigint, text string, _cut boolean, _split bigint")
    found, _ = stored(found)
    parts = found.filter("_cut").groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("_split", "text"))).alias("_p"))
    stitched = parts.select("file", "record_no", F.array_join(F.transform("_p", lambda p: p["text"]), separator).alias("text"))
    return found.filter("not _cut").select("file", "record_no", "text").unionByName(stitched)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Stretches of a batch that belong to one split, and whether the split begins with it."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        file, at = b.column("file"), b.column("_split").to_numpy()
        change = (at[1:] != at[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for a, e in zip(edges, edges[1:]):
            key = file[a].as_py(), int(at[a])
            yield key != last, b.slice(a, e - a)
            last = key


def _flags(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_o", "_i", "_says"))


def _states(o: np.ndarray, i: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """State (inside quotes?) in front of and behind every piece, of a stretch entered in state ``inside``."""
    setter = np.maximum.accumulate(np.where(o == i, np.arange(len(o)), -1))
    flips = np.cumsum(o & ~i)
    since = flips - np.where(setter >= 0, flips[setter], 0)
    behind = np.where(setter >= 0, o[setter], inside) ^ (since % 2 == 1)
    return np.concatenate([[inside], behind[:-1]]), behind


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split the state behind it and the records begun in it, if it is entered outside (0) or inside (1)."""
    rows = []
    for begins, b in _stretches(batches):
        if begins:
            rows.append({"file": b.column("file")[0].as_py(), "_split": b.column("_split")[0].as_py(), "e0": False, "e1": True, "t0": 0, "t1": 0})
        o, i, says = _flags(b)
        for k in "01":
            front, behind = _states(o, i, rows[-1]["e" + k])
            rows[-1]["e" + k] = bool(behind[-1])
            rows[-1]["t" + k] += int((~front & says).sum())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("_split", pa.int64()), ("e0", pa.bool_()),
                                                          ("e1", pa.bool_()), ("t0", pa.int64()), ("t1", pa.int64())]))


def _records(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[pa.RecordBatch]:
    """Records of every split, their pieces joined; ``_cut``: begun in front of the split, or open behind it."""
    names = ["file", "record_no", "text", "_cut", "_split"]
    file = at = None
    inside, number, held, whole = False, -1, [], True  # held: pieces so far of the record that is open

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([number], pa.int64()), pa.array([separator.join(held)], pa.string()),
                                           pa.array([not (whole and not inside)]), pa.array([at], pa.int64())], names)

    for begins, b in _stretches(batches):
        if begins:
            if held:
                yield one()
            file, at = b.column("file")[0].as_py(), b.column("_split")[0].as_py()
            inside, number, held, whole = b.column("_in")[0].as_py(), b.column("_base")[0].as_py() - 1, [], True
            whole = not inside
        o, i, says = _flags(b)
        front, behind = _states(o, i, inside)
        kept = front | says
        first = (~front & says)[kept]  # does a record begin with this piece?
        texts = b.column("text").filter(pa.array(kept))
        starts = np.flatnonzero(first)
        head = int(starts[0]) if len(starts) else len(texts)
        if head:  # the open record goes on
            held.append(_joined(texts.slice(0, head), [0, head], separator)[0].as_py())
        inside = bool(behind[-1])
        if len(starts):
            if held:
                was, inside = inside, False
                yield one()
                inside = was
            tail = int(starts[-1]) if inside else len(texts)
            done = starts[starts < tail]
            if len(done):
                edges = np.append(done, tail)
                yield pa.RecordBatch.from_arrays([
                    b.column("file").slice(0, len(done)), pa.array(number + 1 + np.arange(len(done)), pa.int64()),
                    _joined(texts, edges, separator), pa.array(np.zeros(len(done), bool)), pa.array(np.full(len(done), at), pa.int64())], names)
            number += len(starts)
            held, whole = [], True
            if inside:
                held.append(_joined(texts, [tail, len(texts)], separator)[0].as_py())
        elif held and not inside:
            yield one()
            held, whole = [], True
    if held:
        yield one()


def _joined(texts: pa.Array, edges, separator: str) -> pa.Array:
    """The texts between neighbouring edges, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), texts), separator)


def _entering(ends: DataFrame) -> DataFrame:
    """State and number of records in front of every split: the same scan over one row per split."""
    e0, e1 = F.col("e0"), F.col("e1")
    flip = (e0 & ~e1).cast("bigint")
    along = Window.partitionBy("file").orderBy("_split")
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    s = ends.withColumn("_f", F.sum(flip).over(upto))
    s = s.withColumn("_c", F.last(F.when(e0 == e1, F.struct(e0.alias("o"), F.col("_f").alias("f"))), ignorenulls=True).over(before))
    odd = (F.col("_f") - flip - F.coalesce(F.col("_c.f"), F.lit(0))) % 2 == 1
    s = s.withColumn("_in", F.coalesce(F.col("_c.o"), F.lit(False)) != odd)
    begun = F.when(F.col("_in"), F.col("t1")).otherwise(F.col("t0"))
    return s.select("file", "_split", "_in", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("_base"))


def csv_values(record: Column) -> Column:
    """Fields of a CSV record: quotes taken off, doubled ones made single; empty fields are null."""
    field = r'"(?:[^"]++|"")*+(?:"[^,]*+|\z)|[^,]*+'
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({field})"), F.lit(1))

    def value(f: Column) -> Column:
        part = lambda k: F.regexp_extract(f, r'(?s)\A"((?:[^"]++|"")*+)"?(.*)\z', k)
        bare = F.concat(F.replace(part(1), F.lit('""'), F.lit('"')), part(2))
        return F.nullif(F.when(f.startswith('"'), bare).otherwise(f), F.lit(""))

    return F.transform(fields, value)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    r"""``(file, record_no, values)`` of header-less CSV files with any number of fields a record. Lines end
    with ``\n`` or ``\r\n``; line breaks inside quotes stay as they are."""
    r = read_records(spark, path, "\n", CSV_OPENS, CSV_STAYS, r"\A\r?\z")
    return r.select("file", "record_no", csv_values(F.regexp_replace("text", r"\r\z", "")).alias("values"))
