"""Scalar text functions, all native Spark expressions (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens of at least two word characters (letters, digits, underscore),
# Unicode-aware; Java's plain \w is ASCII only and would split umlauts.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace (Unicode), like Python ``str.strip()``."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def lower_strip(c) -> Column:
    return strip_ws(F.lower(_c(c)))


def strip_chars(c, chars: str) -> Column:
    """Strip a set of characters from both ends, like ``str.strip(chars)``."""
    cls = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)
    return F.regexp_replace(_c(c), f"^[{cls}]+|[{cls}]+$", "")


def tokens(c) -> Column:
    """Lower-cased word tokens of length >= 2 as ``array<string>``."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def safe_name(c) -> Column:
    """Every character outside ``[A-Za-z0-9_-]`` becomes ``_``."""
    return F.regexp_replace(_c(c), r"[^a-zA-Z0-9_\-]", "_")


def sheet_name(n, title) -> Column:
    """Numbered sheet name: 3-digit number, blank, first 27 characters of the title,
    then characters a sheet name cannot hold replaced by ``_``."""
    raw = F.concat(F.format_string("%03d", _c(n).cast("bigint")), F.lit(" "), F.substring(_c(title), 1, 27))
    return F.regexp_replace(raw, r"[\\/*?:$]", "_")


def strip_prompt(output, prompt) -> Column:
    """Remove the echoed prompt from a generated text: ``out[len(prompt):].strip()``."""
    return strip_ws(F.substring(_c(output), F.length(_c(prompt)) + 1, 1 << 30))


def _two_product(a: Column, b: float):
    """Exact product ``a*b = p + e`` with Veltkamp splitting (no FMA needed)."""
    split = 134217729.0  # 2**27 + 1
    ca = a * F.lit(split)
    ah = ca - (ca - a)
    al = a - ah
    cb = b * split
    bh = cb - (cb - b)
    bl = b - bh
    p = a * F.lit(float(b))
    e = ((ah * F.lit(bh) - p) + ah * F.lit(bl) + al * F.lit(bh)) + al * F.lit(bl)
    return p, e


def format_fixed(c, digits: int = 2) -> Column:
    """``'%.{digits}f'`` with the rounding of the exact binary value (ties to even),
    as Python and C print doubles. Spark's ``format_string`` rounds half-up on the
    shortest decimal instead (0.125 -> 0.13, 2.675 -> 2.68); this does not.
    """
    v = _c(c).cast("double")
    scale = float(10 ** digits)
    p, e = _two_product(v, scale)
    k0 = F.floor(p).cast("double")
    frac = p - k0
    up = (F.when(frac > 0.5, True)
          .when(frac < 0.5, False)
          .when(e > 0, True)
          .when(e < 0, False)
          .otherwise(F.pmod(k0, F.lit(2.0)) != 0))
    k = F.when(up, k0 + 1).otherwise(k0)
    txt = F.format_string(f"%.{digits}f", k / F.lit(scale))
    neg_zero = (v < 0) & (k == 0)
    zero = "0." + "0" * digits if digits > 0 else "0"
    out = F.when(neg_zero, F.lit("-" + zero)).otherwise(txt)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan")).otherwise(out)


def token_budget(c, max_tokens: int):
    """Whitespace-token budget of a text (re-aimed subword budget).

    Returns a struct: ``n_tokens``, ``kept_text`` (first ``max_tokens`` tokens),
    ``n_pad`` (padding to the budget) and ``truncated``.
    """
    toks = F.split(strip_ws(_c(c)), r"\s+")
    toks = F.when(strip_ws(_c(c)) == "", F.array().cast("array<string>")).otherwise(toks)
    n = F.size(toks)
    return F.struct(
        n.cast("bigint").alias("n_tokens"),
        F.array_join(F.slice(toks, 1, max_tokens), " ").alias("kept_text"),
        F.greatest(F.lit(max_tokens) - n, F.lit(0)).cast("bigint").alias("n_pad"),
        (n > max_tokens).alias("truncated"),
    )
