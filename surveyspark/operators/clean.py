"""Column cleaning: null profile (A1), sparse-column drop (P2), target split (P1),
named drop (P3), dictionary rename (P4), whitespace normalisation (P5),
default fill (P6), category codes (P7)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lower_strip
from ..session import cut_lineage
from .broadcast import stored_side
from .codebook import whole_number

_FLOATS = (T.DoubleType, T.FloatType)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _is_missing(df: DataFrame, name: str):
    c = F.col(_q(name))
    if isinstance(df.schema[name].dataType, _FLOATS):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Long table ``(pos, column, n_rows, n_null, null_pct)``; NaN counts as null.

    One aggregate pass over all columns at once (partial aggregation per task),
    then the single result row is turned long with ``stack``.
    """
    cols = list(columns) if columns is not None else df.columns
    aggs = [F.count(F.lit(1)).cast("bigint").alias("_n")]
    aggs += [F.sum(F.when(_is_missing(df, c), 1).otherwise(0)).cast("bigint").alias(f"_m{i}")
             for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"{i}, '{c.replace(chr(39), chr(39) * 2)}', _m{i}" for i, c in enumerate(cols))
    long = one.selectExpr("_n", f"stack({len(cols)}, {pairs}) AS (pos, column, n_null)")
    return long.select(
        F.col("pos").cast("bigint").alias("pos"), "column", F.col("_n").alias("n_rows"), "n_null",
        F.when(F.col("_n") > 0, 100.0 * F.col("n_null") / F.col("_n")).alias("null_pct"))


def sparse_columns(df: DataFrame, threshold: float) -> list[str]:
    """Columns whose null percentage is strictly above ``threshold`` (one-row collect)."""
    prof = null_profile(df).filter(F.col("null_pct") > F.lit(float(threshold)))
    return [r["column"] for r in prof.orderBy("pos").collect()]


def drop_sparse_columns(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def split_target(df: DataFrame, target: str, key: str | None = None, as_int: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features (all but the target) and the target (with ``key`` when given). ``as_int``: the target
    as a whole number, fractions cut off; null where it is no number."""
    y = whole_number(F.col(target)).alias(target) if as_int else F.col(target)
    return df.drop(target), df.select(*([key] if key else []), y)


def drop_named_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns; names not present are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def rename_by_dictionary(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by dictionary; unmapped names stay. When several columns map to one
    name, the first (in column order) takes it and the others become
    ``<name>__<original>`` so no column is ambiguous."""
    taken: set[str] = set()
    out = {}
    for c in df.columns:
        new = mapping.get(c, c)
        if new in taken:
            new = f"{new}__{c}"
        taken.add(new)
        if new != c:
            out[c] = new
    return df.withColumnsRenamed(out) if out else df


def normalize_text(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Lower-case, then strip surrounding whitespace (Unicode), per column."""
    return df.withColumns({c: lower_strip(F.col(_q(c))) for c in cols})


def fill_defaults(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace null (and NaN) by a constant per column.

    A value whose type does not fit the column turns the column into text (the
    constant and the existing values as strings), like an object column.
    """
    out = {}
    for c, v in values.items():
        if c not in df.columns:
            continue
        dt = df.schema[c].dataType
        col = F.col(_q(c))
        if isinstance(dt, _FLOATS):
            col = F.when(F.isnan(col), F.lit(None).cast(dt)).otherwise(col)
        numeric = isinstance(dt, T.NumericType)
        if isinstance(v, str) and numeric:
            out[c] = F.coalesce(col.cast("string"), F.lit(v))
        elif isinstance(v, (int, float)) and not numeric:
            out[c] = F.coalesce(col.cast("string"), F.lit(str(v)))
        else:
            out[c] = F.coalesce(col, F.lit(v).cast(dt))
    return df.withColumns(out) if out else df


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """``(_v, _code)``: 0-based rank of every distinct non-null value in sorted order.

    The distinct values are range-partitioned (a distributed sort), the partitioning is fixed
    by a checkpoint into the shared folder, and every partition is numbered from the counts of
    the partitions before it (one row per partition).
    """
    vals = df.select(F.col(_q(col)).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    ranged = cut_lineage(vals.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    cnt = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy("_v")) - 1
    return ranged.join(F.broadcast(off), "_p").select("_v", (F.col("_off") + local).cast("bigint").alias("_code"))


def encode_categories(df: DataFrame, cols: Iterable[str], suffix: str = "_code") -> DataFrame:
    """Category codes in sorted order of the distinct values (0-based); null -> -1.

    Per column the distinct values are ranked (``category_codes``) and joined back: the code
    table is broadcast after a check of its size, so rows are not shuffled onto a few values;
    beyond it the join is by sort and merge, with hot values split at run time.
    """
    out = df
    for c in cols:
        lut = stored_side(category_codes(df, c))
        out = (out.join(lut, out[_q(c)] == lut["_v"], "left")
                  .withColumn(c + suffix, F.coalesce(F.col("_code"), F.lit(-1).cast("bigint")))
                  .drop("_v", "_code"))
    return out
