"""Rule and fuzzy standardisation of free-text categories against a dictionary."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .broadcast import stored_side

# The rules applied before fuzzy matching, in order
# (substring of the lower-cased text -> category); a missing value becomes
# MISSING_CATEGORY.
MISSING_CATEGORY = "keine angabe"
DEFAULT_RULES: tuple[tuple[str, str], ...] = (
    ("techniker", "tk"),
    ("dak gesundheit", "dak"),
    ("a0k", "aok"),
)

def ratio_score(a: Column, b: Column, cutoff: float | None = None) -> Column:
    """Normalised Levenshtein similarity ``100 * (1 - lev / max(len))`` (100 for two
    empty strings). With ``cutoff`` the banded distance is used and scores below
    the cutoff become 0 (only matches above the cutoff matter)."""
    m = F.greatest(F.length(a), F.length(b))
    if cutoff is None:
        d = F.levenshtein(a, b)
    else:
        band = F.floor((1.0 - F.lit(float(cutoff)) / 100.0) * m).cast("int")
        d = F.call_function("levenshtein", a, b, band)
    s = F.lit(100.0) * (F.lit(1.0) - d / m)
    return F.when(m == 0, F.lit(100.0)).when(d < 0, F.lit(0.0)).otherwise(s)


GRAMS = (1, 2, 3)  # characters of a gram, by how many the allowed edits leave shared
BLOCK_TERMS = 1 << 14  # dictionary terms that one index holds (and 64 times as many characters)
VALUES_AT_ONCE = 1 << 13
_AT_ONCE = 1 << 21  # places of the index looked at together


class Grams:
    """All grams of some texts: code (its characters), text and place, and the texts' lengths."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.char = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.text = np.repeat(np.arange(len(texts)), self.size)
        self.place = np.arange(len(self.char)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self._pairs = None

    def of(self, q: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, text, place) of the grams of ``q`` characters of the texts in ``keep``."""
        at = np.flatnonzero(keep[self.text] & (self.place + q <= self.size[self.text]))
        code = self.char[at]
        for k in range(1, q):
            code = code << np.uint64(21) | self.char[at + k]
        return code, self.text[at], self.place[at]


    def pairs(self) -> np.ndarray:
        """Numbers of neighbouring characters of every text in 256 hashed cells (of texts up to 255)."""
        if self._pairs is None:
            code, text, _ = self.of(2, self.size <= 255)
            cell = ((code >> np.uint64(21)) * np.uint64(31) + code) & np.uint64(255)
            self._pairs = np.bincount(text * 256 + cell.astype(np.int64), minlength=len(self.size) * 256).astype(np.uint8).reshape(-1, 256)
        return self._pairs


def _limits(longest: int, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the length of a pair's longer text: the edits allowed, the gram to use, and how many stay
    shared. An edit touches at most q grams of q characters, so of the longer text's grams all but d * q
    are found in the other, shifted by no more than insertions and deletions among the d edits allow:
    there, and from there to the texts' ends. The longest gram that leaves two is used."""
    n = np.arange(longest + 1)
    d = np.floor((1.0 - cutoff / 100.0 + 1e-9) * n).astype(np.int64)
    q, shared = np.ones(len(n), np.int64), n - d
    for k in GRAMS[1:]:
        left = n - (k - 1) - d * k
        q, shared = np.where(left >= 2, k, q), np.where(left >= 2, left, shared)
    return d, q, shared


class TermIndex:
    """Grams of a block of terms, sorted, and the bounds for pairs with texts of up to ``longest`` characters."""

    def __init__(self, terms: list[str], longest: int, cutoff: float):
        self.grams = Grams(terms)
        self.d, self.q, self.shared = _limits(max(longest, int(self.grams.size.max(initial=0))), cutoff)
        n = np.arange(len(self.d))
        most = np.minimum(np.floor(n / (cutoff / 100.0) + 1e-9).astype(np.int64), len(n) - 1)  # longest partner
        self.uses, self.sorted = {}, {}
        for q in GRAMS:
            upto = np.concatenate([[0], np.cumsum(self.q == q)])
            self.uses[q] = upto[most + 1] > upto[n]  # may a pair with a text of this length use q?
            code, term, place = self.grams.of(q, self.uses[q][self.grams.size])
            order = np.argsort(code, kind="stable")
            self.sorted[q] = code[order], term[order], place[order]

    def meet(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (value, term) of pairs among which all that score at least the cutoff are: enough grams of
        the value stand in the term, near enough to the same place, and the lengths can score."""
        one, two, d, terms = Grams(values), self.grams, self.d, max(1, len(self.grams.size))
        empty = np.meshgrid(np.flatnonzero(one.size == 0), np.flatnonzero(two.size == 0), indexing="ij")  # at most one term
        found = [np.stack([x.reshape(-1) for x in empty], 1)]
        for q in GRAMS:
            code, term, there = self.sorted[q]
            asked, value, here = one.of(q, self.uses[q][one.size])
            first, last = np.searchsorted(code, asked, "left"), np.searchsorted(code, asked, "right")
            reach = last - first
            # whole values together, so many that their places and counts stay bounded
            border = np.searchsorted(value, np.arange(len(values) + 1))
            weight = np.concatenate([[0], np.cumsum(reach)])[border]
            at = 0
            while at < len(values):
                by_places = int(np.searchsorted(weight, weight[at] + _AT_ONCE, "right")) - 1
                end = max(at + 1, min(by_places, at + max(1, _AT_ONCE // terms), len(values)))
                a, b = border[at], border[end]
                own = np.repeat(np.arange(a, b), reach[a:b])
                met = np.repeat(first[a:b] - (np.cumsum(reach[a:b]) - reach[a:b]), reach[a:b]) + np.arange(int(reach[a:b].sum()))
                v, t = value[own], term[met]
                longest = np.maximum(one.size[v], two.size[t])
                shift, at_end = here[own] - there[met], one.size[v] - two.size[t]
                near = (self.q[longest] == q) & (np.abs(shift) + np.abs(shift - at_end) <= d[longest])
                n = np.bincount((v[near] - at) * terms + t[near], minlength=(end - at) * terms)
                hit = np.flatnonzero(n)
                v, t = hit // terms + at, hit % terms
                longest = np.maximum(one.size[v], two.size[t])
                enough = n[hit] >= self.shared[longest]
                v, t, longest = v[enough], t[enough], longest[enough]
                enough = _share_pairs(one, two, v, t, longest - 1 - 2 * d[longest])
                found.append(np.stack([v[enough], t[enough]], 1))
                at = end
        pairs = np.concatenate(found)
        return pairs[:, 0], pairs[:, 1]


def _share_pairs(one: Grams, two: Grams, v: np.ndarray, t: np.ndarray, least: np.ndarray) -> np.ndarray:
    """May each pair share ``least`` pairs of neighbouring characters? Counted in 256 hashed cells, which
    never counts too few; texts beyond 255 characters pass."""
    out = np.ones(len(v), bool)
    for a in range(0, len(v), 1 << 14):
        part = slice(a, a + (1 << 14))
        both = np.minimum(one.pairs()[v[part]], two.pairs()[t[part]]).sum(1, dtype=np.int64)
        out[part] = (both >= least[part]) | (one.size[v[part]] > 255) | (two.size[t[part]] > 255)
    return out


def candidates(values: DataFrame, terms: DataFrame, cutoff: float, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Pairs ``(_low, term, pos)`` among which all that score at least ``cutoff`` are.

    Terms are cut into blocks of bounded size, each an index of grams in one task per share of the
    values; a value is looked up once per block. Only pairs that share enough grams leave a task."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_terms), -(-int(size["chars"] or 0) // (64 * block_terms)))
    shares = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = values.select("_low", every(blocks).alias("block"), F.pmod(F.xxhash64("_low"), F.lit(shares)).cast("int").alias("share"))
    t = terms.select("term", "pos", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("at_block"), every(shares).alias("at_share"))
    schema = f"_low string, term string, pos {terms.schema['pos'].dataType.simpleString()}"

    def look_up(v: pa.Table, t: pa.Table) -> pa.Table:
        low, parts = v.column("_low"), []
        longest = int(pc.max(pc.utf8_length(low)).as_py() or 0) if v.num_rows else 0
        index = TermIndex(t.column("term").to_pylist(), longest, cutoff)
        for at in range(0, v.num_rows if t.num_rows else 0, VALUES_AT_ONCE):
            part = low.slice(at, VALUES_AT_ONCE)
            one, two = (pa.array(x, pa.int64()) for x in index.meet(part.to_pylist()))
            parts.append(pa.table({"_low": part.take(one), "term": t.column("term").take(two), "pos": t.column("pos").take(two)}))
        none = pa.table({"_low": low.slice(0, 0), "term": t.column("term").slice(0, 0), "pos": t.column("pos").slice(0, 0)})
        return pa.concat_tables([none, *parts])

    return v.groupBy("block", "share").cogroup(t.groupBy("at_block", "at_share")).applyInArrow(look_up, schema)


def best_matches(values: DataFrame, terms: DataFrame, cutoff: float) -> DataFrame:
    """``(_low, _best)``: the best term of every text that has one scoring at least ``cutoff`` (above 0;
    ties to the smallest ``pos``); ``values`` has ``_low``, ``terms`` has ``term`` and ``pos``. Every pair
    of ``candidates`` is scored once."""
    if not 0 < cutoff <= 100:
        raise ValueError("the cutoff is a score above 0, at most 100")
    pairs = candidates(values.select("_low"), terms.select("term", "pos"), cutoff)
    scored = pairs.withColumn("score", ratio_score(F.col("_low"), F.col("term"), cutoff)).filter(F.col("score") >= cutoff)
    return scored.groupBy("_low").agg(F.max(F.struct("score", (-F.col("pos")).alias("npos"), "term")).alias("b")).select(
        "_low", F.col("b.term").alias("_best"))


def standardize_categories(df: DataFrame, col: str, dictionary: DataFrame, cutoff: float = 70.0,
                           out: str | None = None, pos: str = "pos", term: str = "term",
                           rules: Sequence[tuple[str, str]] = DEFAULT_RULES) -> DataFrame:
    """null -> 'keine angabe'; lower-case; substring rules; else the best dictionary
    term scoring at least ``cutoff``; else the lower-cased text.

    The distinct values are matched once, through an index of grams (``best_matches``), and joined back; missing
    values take no part in the joins, and a value or dictionary table within the broadcast bound
    is broadcast after a check of its size.
    """
    out = out or col
    terms = (dictionary.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.min(pos).alias("pos")))
    vals = df.select(F.col(col).alias("_raw")).filter(F.col("_raw").isNotNull()).distinct().withColumn("_low", F.lower("_raw"))
    rule = None
    for needle, cat in rules:
        hit = F.instr(F.col("_low"), needle) > 0
        rule = F.when(hit, F.lit(cat)) if rule is None else rule.when(hit, F.lit(cat))
    vals = vals.withColumn("_rule", rule if rule is not None else F.lit(None).cast("string"))
    best = best_matches(vals.filter(F.col("_rule").isNull()).select("_low").distinct(), terms, float(cutoff))
    lut = vals.join(best, "_low", "left").select("_raw", F.coalesce("_rule", "_best", "_low").alias("_std"))
    lut = stored_side(lut)
    # a missing value hashes to its own row number, not to one task
    key = F.coalesce(F.col(col), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    j = df.withColumn("_key", key).join(lut, F.col("_key") == F.col("_raw"), "left")
    return j.withColumn(out, F.when(F.col(col).isNull(), F.lit(MISSING_CATEGORY)).otherwise(F.col("_std"))) \
            .drop("_key", "_raw", "_std")
