"""Size-checked broadcast.

A side is broadcast only when it is proven small: a bounded ``limit(cap + 1).count()``
stops reading as soon as the cap is passed. Beyond the cap the join is left to
the planner (sort-merge, or a runtime broadcast chosen by AQE from real shuffle
sizes). Derived tables whose size is only known after a shuffle should not be
checked this way (the check would run the shuffle twice): leave those to AQE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# A lookup that is shipped to every executor holds at most this many rows and this many bytes
# (measured on its rows as JSON, which is more than their binary form).
DEFAULT_MAX_ROWS = 2_000_000
MAX_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    found = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("bigint")).alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, lut_rows_hint: bool = False) -> DataFrame:
    """Broadcast ``df`` when it has at most ``max_rows`` rows.

    ``lut_rows_hint=True`` marks a derived table: no eager check, the join strategy
    is left to AQE, which broadcasts at run time when the built side is small.
    """
    if lut_rows_hint:
        return df
    return F.broadcast(df) if is_small(df, max_rows) else df


def small_side(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """The lookup side of a join: broadcast when proven small, otherwise marked for
    a sort-merge join, so that the planner never broadcasts the other (large)
    side on a low size estimate (exploded rows, or a side without statistics such
    as a checkpoint). AQE still may pick a broadcast from measured shuffle sizes."""
    return F.broadcast(df) if is_small(df, max_rows) else df.hint("merge")


# A stored table whose files are at most this large is a look-up that every executor may hold (files are
# compressed; in memory it is some times as much).
MAX_STORED_BYTES = 8 << 20


def stored(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows as a table in the shared checkpoint folder, which cuts their lineage, and whether they are
    few enough to be broadcast, by the size of the table's files: no job but the write."""
    path = f"{checkpoint_dir(df.sparkSession)}/lookup-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    size = out._jdf.queryExecution().analyzed().stats().sizeInBytes()
    return out, int(str(size)) <= MAX_STORED_BYTES


def stored_side(df: DataFrame) -> DataFrame:
    """The lookup side of a join, stored, and broadcast if its files are small; else by sort and merge."""
    out, small = stored(df)
    return F.broadcast(out) if small else out.hint("merge")
