"""Codebook decoding: forward fill (W1), option labels (X1), question labels (X2),
question types (X3), long answers (P10) and decoded answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .broadcast import stored


# Question types and how a plain (undotted) answer is rendered.
LABELLED_TYPES = ("Single Select", "Dropdown", "Rating Scale", "Single Matrix", "Rating Matrix")
RAW_TYPES = ("Number Input", "Net Promoter Score®")
UNKNOWN_FORMAT = {  # type -> text used when a code has no label
    "Single Select": "(Unknown code {})",
    "Dropdown": "(Unknown code {})",
    "Rating Scale": "(Unknown rating {})",
    "Single Matrix": "(Unknown response {})",
    "Rating Matrix": "(Unknown response {})",
}
CODEBOOK_CHUNK = 4096  # codebook rows filled in one task
MULTI_SELECT = "Multiple Select"
OPEN_TEXT = "Open Text"
RANKING = "Ranking"


def forward_fill(df: DataFrame, cols: Sequence[str], order: Sequence[str],
                 partition: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Carry the last non-null value forward in ``order`` (within ``partition``).

    Without ``bucket`` this is one running window per partition key. With
    ``bucket`` (an expression that is non-decreasing in ``order``, e.g. the day of
    a timestamp) a hot partition key is split: each (key, bucket) is filled in its
    own task, the last value of every bucket is carried across buckets on the
    small per-bucket table, and joined back. Without a partition the window runs
    in one task: use that only for small tables such as a codebook.
    """
    part, order = list(partition), list(order)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if bucket is None:
        if part:
            w = w.partitionBy(*part)
        return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})
    d = in_buckets(df, part, bucket)
    wb = Window.partitionBy("_scan_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({c: F.last(F.col(c), ignorenulls=True).over(wb) for c in cols})
    ordkey = F.struct(*[F.col(o) for o in order])
    last = d.groupBy("_scan_key").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(f"_l_{c}")
                                   for c in cols])
    wc = over_buckets(part)
    carry = last.select("_scan_key", *[F.last(F.col(f"_l_{c}"), ignorenulls=True).over(wc).alias(f"_c_{c}") for c in cols])
    out = d.join(carry, "_scan_key").withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in cols})
    return out.drop("_scan_key", *[f"_c_{c}" for c in cols])


def in_buckets(df: DataFrame, part: Sequence[str], bucket: Column) -> DataFrame:
    """Adds ``_scan_key``, a struct of the partition and its bucket. A struct is never null, so null keys are
    keys like any other, and window, aggregation and join by it share one exchange of the rows."""
    return df.withColumn("_scan_key", F.struct(*[F.col(p).alias(f"p{i}") for i, p in enumerate(part)], bucket.alias("bucket")))


def over_buckets(part: Sequence[str]):
    """Window over the buckets in front of a bucket, on a table of one row per ``_scan_key``."""
    w = Window.orderBy("_scan_key.bucket").rowsBetween(Window.unboundedPreceding, -1)
    return w.partitionBy(*[f"_scan_key.p{i}" for i in range(len(part))]) if part else w


def join_null_safe(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of every row with the carry of its key; null keys are keys like any other."""
    carry = carry.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    cond = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k_{i}"))
        cond = same if cond is None else cond & same
    return rows.join(carry, cond, "left").drop(*[f"_k_{i}" for i in range(len(keys))])


def running_sums(df: DataFrame, cols: dict[str, Column], order: Sequence[str], partition: Sequence[str] = (),
                 bucket: Column | None = None) -> DataFrame:
    """Inclusive running sums ``{out: expression}`` in ``order`` within ``partition``.

    With ``bucket`` (non-decreasing in ``order``) it is a two-level scan: every
    (key, bucket) is summed in its own task, the bucket totals are summed across
    buckets on the small per-bucket table, and that carry is joined back, so a
    single huge partition key is spread over many tasks.
    """
    part, order = list(partition), list(order)
    d = df.withColumns({f"_x_{o}": e for o, e in cols.items()})
    if bucket is None:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        if part:
            w = w.partitionBy(*part)
        return d.withColumns({o: F.sum(f"_x_{o}").over(w) for o in cols}).drop(*[f"_x_{o}" for o in cols])
    d = in_buckets(d, part, bucket)
    wb = Window.partitionBy("_scan_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_r_{o}": F.sum(f"_x_{o}").over(wb) for o in cols})
    tot = d.groupBy("_scan_key").agg(*[F.sum(f"_x_{o}").alias(f"_t_{o}") for o in cols])
    wc = over_buckets(part)
    carry = tot.select("_scan_key", *[F.coalesce(F.sum(f"_t_{o}").over(wc), F.lit(0)).alias(f"_c_{o}") for o in cols])
    out = d.join(carry, "_scan_key").withColumns({o: F.col(f"_r_{o}") + F.col(f"_c_{o}") for o in cols})
    return out.drop("_scan_key", *[f"_{p}_{o}" for o in cols for p in ("x", "r", "c")])


_NUMERIC = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def whole_number(c: Column) -> Column:
    """The whole part of a number written as text; null for other text and beyond 64 bits."""
    s = strip_ws(c.cast("string"))
    n = F.when(s.rlike(_NUMERIC), s.try_cast("double"))
    return F.when(F.abs(n) < 2.0 ** 63, n.try_cast("bigint"))


def canonical_code(c: Column) -> Column:
    """Answer/option code as text: numbers lose their fraction (``1.0`` -> ``1``,
    truncation like ``int()``), other text is only stripped. A number too large for
    64 bits stays text."""
    return F.coalesce(whole_number(c).cast("string"), strip_ws(c.cast("string")))


def fill_codebook(codebook: DataFrame) -> DataFrame:
    """Forward fill question, type and name over the codebook row order, in chunks of rows:
    a codebook of any length is filled by many tasks."""
    return forward_fill(codebook, ["question", "type", "name"], ["row_no"],
                        bucket=F.floor(F.col("row_no") / CODEBOOK_CHUNK))


def codebook_options(codebook: DataFrame, filled: bool = False) -> DataFrame:
    """``(qid, code, label)``: rows with a value and a label; the last row wins."""
    cb = codebook if filled else fill_codebook(codebook)
    opt = cb.filter(F.col("value").isNotNull() & F.col("label").isNotNull())
    return (opt.groupBy(F.col("question").alias("qid"), canonical_code(F.col("value")).alias("code"))
               .agg(F.max_by(strip_ws(F.col("label").cast("string")), F.col("row_no")).alias("label")))


def question_labels(codebook: DataFrame, filled: bool = False, last_label: bool = False) -> DataFrame:
    """``(qid, qlabel, last_label)``: text of the last row without a value; when
    absent or empty, the first name. ``last_label`` is the label of the last
    non-null-label row (used for the sub-question quirk)."""
    cb = codebook if filled else fill_codebook(codebook)
    return cb.groupBy(F.col("question").alias("qid")).agg(_qlabel().alias("qlabel"), _last_label().alias("last_label"))


def question_types(codebook: DataFrame, filled: bool = False) -> DataFrame:
    """``(qid, qtype)``: last non-null type of the question (the filled type of a block's first
    rows may still be that of the question before)."""
    cb = codebook if filled else fill_codebook(codebook)
    return cb.groupBy(F.col("question").alias("qid")).agg(_qtype().alias("qtype"))


def _qlabel() -> Column:
    return F.coalesce(F.max_by(F.col("label"), F.when(F.col("value").isNull(), F.col("row_no"))),
                      F.min_by(F.col("name"), F.when(F.col("name").isNotNull(), F.col("row_no"))))


def _last_label() -> Column:
    return F.max_by(F.col("label"), F.when(F.col("label").isNotNull(), F.col("row_no")))


def _qtype() -> Column:
    return F.max_by(F.col("type"), F.when(F.col("type").isNotNull(), F.col("row_no")))


def answers_long(wide: DataFrame, key: str = "pid", prefix: str = "Q") -> DataFrame:
    """Wide answers -> ``(pid, pos, qid, value)`` for columns starting with ``prefix``;
    ``pos`` is the column position, null cells are dropped. Row-local (no shuffle)."""
    cols = [(i, c) for i, c in enumerate(wide.columns) if c.startswith(prefix) and c != key]
    kinds = dict(wide.dtypes)

    def text(c: str) -> Column:
        cell = F.col(f"`{c}`")
        if kinds[c] in ("double", "float"):  # a missing number is missing, not the text NaN
            cell = F.when(~F.isnan(cell), cell)
        return cell.cast("string")

    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(c).alias("qid"),
                             text(c).alias("value")) for i, c in cols])
    return (wide.select(F.col(key).alias("pid"), F.inline(arr))
                .filter(F.col("value").isNotNull()))


def decode_answers(answers: DataFrame, codebook: DataFrame) -> DataFrame:
    """Attach question type, question label and the decoded answer text.

    ``answer`` is the option label for coded types (or the unknown-code text),
    the raw value for number/NPS/other, the quoted value for open text, and
    ``Rank n`` / ``(invalid rank)`` for rankings. The filled codebook is stored once; the
    lookups (question info and options) are broadcast if its files are small, so the answers are
    not shuffled onto a few question ids; beyond that size they are joined by sort and merge, with
    skewed questions split at run time.
    """
    cb, small = stored(fill_codebook(codebook))
    side = F.broadcast if small else (lambda d: d.hint("merge"))  # no look-up is larger than the codebook
    qinfo = cb.groupBy(F.col("question").alias("qid")).agg(_qtype().alias("qtype"), _qlabel().alias("qlabel"), _last_label().alias("last_label"))
    opts = codebook_options(cb, filled=True).withColumnRenamed("label", "opt_label")
    a = (answers.join(side(qinfo), "qid", "left").withColumn("code", canonical_code(F.col("value")))
                .join(side(opts), ["qid", "code"], "left"))
    qtype = F.coalesce(F.col("qtype"), F.lit(""))
    v = F.col("value")
    num = whole_number(v)
    unknown = None
    for ty, fmt in UNKNOWN_FORMAT.items():
        cond = qtype == ty
        txt = F.format_string(fmt.replace("{}", "%s"), v)
        unknown = F.when(cond, txt) if unknown is None else unknown.when(cond, txt)
    dotted_unknown = F.format_string("(Unknown code %s)", v)
    is_dotted = F.col("qid").contains(".")
    coded = F.col("opt_label")
    plain = (F.when(qtype.isin(*LABELLED_TYPES), F.coalesce(coded, unknown))
              .when(qtype.isin(*RAW_TYPES), v)
              .when(qtype == OPEN_TEXT, F.concat(F.lit('"'), v, F.lit('"')))
              .when(qtype == RANKING, F.when(num.isNotNull(), F.concat(F.lit("Rank "), num.cast("string")))
                                       .otherwise(F.lit("(invalid rank)")))
              .otherwise(v))
    sub = F.when(qtype.isin(*LABELLED_TYPES), F.coalesce(coded, dotted_unknown)).otherwise(v)
    answer = F.when(is_dotted, sub).otherwise(plain)
    return a.select("pid", "pos", "qid", "value", qtype.alias("qtype"),
                    F.coalesce(F.col("qlabel"), F.col("qid")).alias("qlabel"),
                    F.col("last_label"), F.col("opt_label"), answer.alias("answer"))
