"""Run comparison: union of labelled runs (U1), means (A9), Welch t-test (A11),
box summaries (A13) and alias lookup (X5)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..session import cut_lineage
from .broadcast import maybe_broadcast, small_side
from .codebook import join_null_safe, running_sums


def union_runs(runs: Mapping[str, DataFrame], run_col: str = "model") -> DataFrame:
    """Stack labelled runs (union all, by name, missing columns become null)."""
    out = None
    for name, df in runs.items():
        d = df.withColumn(run_col, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def mean_by_run(df: DataFrame, run_col: str, metrics: list[str]) -> DataFrame:
    return df.groupBy(run_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                   *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def welch_ttest(df: DataFrame, run_col: str, value: str, run_a: str, run_b: str) -> DataFrame:
    """Welch two-sample t statistic and Welch-Satterthwaite degrees of freedom.

    One global aggregate with map-side partial aggregation (count, mean, sample
    variance per run); the result is one row. t and df are null when a run has
    fewer than two values, or when neither run varies.
    """
    va = F.when(F.col(run_col) == run_a, F.col(value))
    vb = F.when(F.col(run_col) == run_b, F.col(value))
    s = df.agg(
        F.count(va).cast("bigint").alias("n_a"), F.avg(va).alias("mean_a"), F.var_samp(va).alias("var_a"),
        F.count(vb).cast("bigint").alias("n_b"), F.avg(vb).alias("mean_b"), F.var_samp(vb).alias("var_b"),
    )
    a = F.try_divide(F.col("var_a"), F.col("n_a"))
    b = F.try_divide(F.col("var_b"), F.col("n_b"))
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    t = F.when(ok, F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(a + b)))
    dof = F.when(ok, F.try_divide((a + b) * (a + b), a * a / (F.col("n_a") - 1) + b * b / (F.col("n_b") - 1)))
    return s.select(F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b"), "n_a", "n_b",
                    "mean_a", "mean_b", "var_a", "var_b", t.alias("t_stat"), dof.alias("dof"))


# --- two-sided p value: regularised incomplete beta by continued fraction ------

def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float | None:
    if t is None or dof is None or math.isnan(t) or math.isnan(dof):
        return None
    if math.isinf(t):
        return 0.0
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


# Lanczos approximation of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z: Column) -> Column:
    """ln gamma(z) for z >= 0.5."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + F.lit(float(k - 1)))
    t = z + F.lit(6.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z - 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function (Lentz): a fold over as many steps as it
    needs to settle, about the root of the larger parameter."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    steps = F.lit(100) + F.ceil(F.lit(5.0) * F.sqrt(F.greatest(a, b)))

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1.0 + 2.0 * m) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 1.0 + 2.0 * m))
        d1 = 1.0 / tiny(1.0 + even * acc["d"])
        c1 = tiny(1.0 + even / acc["c"])
        half = F.struct(d1.alias("d"), c1.alias("c"), (acc["h"] * d1 * c1).alias("h"))
        return F.element_at(F.transform(F.array(half), lambda s: F.transform(
            F.array(F.struct((1.0 / tiny(1.0 + odd * s["d"])).alias("d"), tiny(1.0 + odd / s["c"]).alias("c"), s["h"].alias("h"))),
            lambda e: F.struct(e["d"].alias("d"), e["c"].alias("c"), (e["h"] * e["d"] * e["c"]).alias("h")))[0]), 1)

    first = 1.0 / tiny(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), steps.cast("int")), lambda m: m.cast("double")), start, step, lambda acc: acc["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b), for a and b of at least 0.5."""
    log_front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)
    low = x < (a + 1.0) / (a + b + 2.0)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1.0 - x)
    part = F.exp(log_front) * _beta_fraction(p, q, y) / p
    inside = F.when(low, part).otherwise(1.0 - part)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's t with ``dof`` degrees of freedom (1 or more); null and NaN stay missing."""
    known = t.isNotNull() & dof.isNotNull() & ~F.isnan(t) & ~F.isnan(dof)
    return F.when(known, F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(
        beta_share(dof / 2.0, F.lit(0.5), dof / (dof + t * t))))


def welch_pvalue(df: DataFrame, run_col: str, value: str, run_a: str, run_b: str) -> DataFrame:
    """Welch test with its two-sided p value, in expressions."""
    r = welch_ttest(df, run_col, value, run_a, run_b)
    return r.withColumn("p_value", two_sided_p(F.col("t_stat"), F.col("dof")))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles with linear interpolation (as ``percentile``) without holding a
    group's values in one task.

    1. one grouped pass: count and ``percentile_approx`` at ``p -/+ margin`` (a mergeable
       sketch) gives a narrow band of values around every wanted rank;
    2. one pass counts the values below the band, the *distinct* values inside it (a hot value
       is one row) and the values above it, with the largest value below and the smallest above;
    3. running counts over those rows, cut into pieces of the band, give the values at ranks
       floor/ceil((n - 1) * p). The margin is four times the sketch's error; where the sketch is
       exact (small groups) the wanted ranks are in the band or next to it.
    Output: ``(group..., n, q0, q1, ...)``.
    """
    group = list(group)
    probs = [float(p) for p in probs]
    m = 4.0 / accuracy
    d = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v")))
    edges = [x for p in probs for x in (max(p - m, 0.0), min(p + m, 1.0))]
    st = cut_lineage(d.groupBy(*group).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                           F.percentile_approx("_v", edges, accuracy).alias("_e")))
    keys = st.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_e")
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)])
    bands = d.join(small_side(keys), same).select(*group, "_v", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(len(probs) - 1)),
        lambda i: F.struct(F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")))).alias("_i", "_b"))
    v, lo, hi = F.col("_v"), F.col("_b.lo"), F.col("_b.hi")
    zone = F.when(v < lo, -1).when(v > hi, 1).otherwise(0)
    piece = F.when(v < lo, -1).when(v > hi, 65).when(hi > lo, F.floor((v - lo) * 64 / (hi - lo))).otherwise(0)
    rows = (bands.withColumn("_zone", zone).withColumn("_piece", piece).withColumn("_key", F.when(F.col("_zone") == 0, v))
            .groupBy(*group, "_i", "_zone", "_piece", "_key")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    rows = running_sums(rows, {"_cum": F.col("_c")}, ["_zone", "_key"], [*group, "_i"], bucket=F.col("_piece"))
    rows = join_null_safe(rows, st.drop("_e"), group)
    at = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
    known = F.when(F.col("_zone") < 0, F.col("_hi")).otherwise(F.col("_lo"))
    last, start = F.col("_cum") - 1, F.col("_cum") - F.col("_c")
    picks = []
    for name, rank in (("_low", F.floor(at)), ("_high", F.ceil(at))):
        holds = (start <= rank) & (last >= rank)
        sure = F.when(F.col("_zone") < 0, rank == last).when(F.col("_zone") > 0, rank == start).otherwise(F.lit(True))
        picks.append(F.max(F.when(holds, F.when(sure, known).otherwise(
            F.raise_error(F.lit("a wanted rank lies outside its band")).cast("double")))).alias(name))
    q = rows.groupBy(*group, "_i").agg(F.first("n").alias("n"), F.first(at - F.floor(at)).alias("_f"), *picks)
    q = q.withColumn("_q", F.col("_low") + F.col("_f") * (F.col("_high") - F.col("_low")))
    return q.groupBy(*group).agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))])


def box_summary(df: DataFrame, run_col: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Box-plot numbers per run: quartiles (linear interpolation), 1.5 IQR whiskers
    at the most extreme values inside the fences, outlier count. Runs without any value are
    left out.

    Quartiles are exact but bounded per task (``exact_quantiles``); the fences
    (one row per run) are joined back for one conditional aggregate: three passes in all.
    """
    q = exact_quantiles(df, [run_col], value, [0.25, 0.5, 0.75], accuracy)
    q = q.select(run_col, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = cut_lineage(q.withColumn("iqr", F.col("q3") - F.col("q1")))
    fences = q.select(F.col(run_col).alias("_run"), (F.col("q1") - 1.5 * F.col("iqr")).alias("_lo"),
                      (F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    w = df.join(small_side(fences), F.col(run_col).eqNullSafe(F.col("_run"))).groupBy("_run").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(v.isNotNull() & ~inside, v)).cast("bigint").alias("n_outliers"))
    return q.join(small_side(w), F.col(run_col).eqNullSafe(F.col("_run"))).drop("_run")


def alias_names(df: DataFrame, name: str, aliases: DataFrame, out: str = "alias",
                key: str = "name", value: str = "alias") -> DataFrame:
    """Short alias of a name from a lookup table, else the name made file-safe."""
    lut = maybe_broadcast(aliases.select(F.col(key).alias("_k"), F.col(value).alias("_a")))
    j = df.join(lut, F.col(name) == F.col("_k"), "left")
    return j.withColumn(out, F.coalesce(F.col("_a"), safe_name(F.col(name)))).drop("_k", "_a")
