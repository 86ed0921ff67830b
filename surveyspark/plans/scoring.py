"""Bindings: explanation scoring and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compare import box_summary, mean_by_run, union_runs, welch_pvalue, welch_ttest
from ..operators.score import tfidf_pair_cosine
from .common import SQL_PAIRS, conversation_pairs, r6, sql_pair_cosine, t
from .registry import query


@query("tfidf_pair_cosine", f"""
WITH {SQL_PAIRS},
{sql_pair_cosine('pairs', 'conv_id, turn')}
SELECT conv_id, turn, round(cosine_similarity, 6) AS cosine_similarity FROM cos
""")
def q_tfidf_pair_cosine(spark, sf):
    pairs = conversation_pairs(t(spark, sf, "conversations"))
    c = tfidf_pair_cosine(pairs, ["conv_id", "turn"], "text_a", "text_b")
    return c.select("conv_id", "turn", r6("cosine_similarity").alias("cosine_similarity"))


RUNS = ("view", "click", "purchase", "signup", "error")


def _runs(spark, sf, names=RUNS):
    ev = t(spark, sf, "events")
    return union_runs({n: ev.filter(F.col("event_type") == n).select("event_id", "value") for n in names})


def _all_runs(spark, sf):
    """Every event, with its type as the run."""
    return t(spark, sf, "events").select("event_id", "value", F.col("event_type").alias("model"))


SQL_RUNS = "runs AS (SELECT event_id, value, event_type AS model FROM events)"


@query("union_runs", f"WITH {SQL_RUNS} SELECT event_id, value, model FROM runs")
def q_union_runs(spark, sf):
    return _runs(spark, sf)


@query("mean_by_run", f"""
WITH {SQL_RUNS}
SELECT model, round(avg(value), 6) AS mean_value, count(*) AS n FROM runs GROUP BY model
""")
def q_mean_by_run(spark, sf):
    m = mean_by_run(_all_runs(spark, sf), "model", ["value"])
    return m.select("model", r6("mean_value").alias("mean_value"), "n")


SQL_WELCH = f"""WITH {SQL_RUNS},
s AS (
  SELECT count(value) FILTER (WHERE model = 'view') AS n_a,
         avg(value) FILTER (WHERE model = 'view') AS mean_a,
         var_samp(value) FILTER (WHERE model = 'view') AS var_a,
         count(value) FILTER (WHERE model = 'click') AS n_b,
         avg(value) FILTER (WHERE model = 'click') AS mean_b,
         var_samp(value) FILTER (WHERE model = 'click') AS var_b
  FROM runs),
w AS (SELECT *, var_a / n_a AS a, var_b / n_b AS b FROM s)
SELECT 'view' AS run_a, 'click' AS run_b, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(var_a, 6) AS var_a, round(var_b, 6) AS var_b,
       round((mean_a - mean_b) / sqrt(a + b), 6) AS t_stat,
       round((a + b) * (a + b) / (a * a / (n_a - 1) + b * b / (n_b - 1)), 6) AS dof
FROM w"""


def _round_stats(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("welch_ttest", SQL_WELCH)
def q_welch_ttest(spark, sf):
    w = welch_ttest(_runs(spark, sf, ("view", "click")), "model", "value", "view", "click")
    return _round_stats(w, {"mean_a", "mean_b", "var_a", "var_b", "t_stat", "dof"})


@query("welch_pvalue", f"""WITH u AS ({SQL_WELCH.strip()}),
e AS (SELECT u.*, w2.t, w2.v FROM u, (SELECT (mean_a - mean_b) / sqrt(a + b) AS t,
        (a + b) * (a + b) / (a * a / (n_a - 1) + b * b / (n_b - 1)) AS v FROM (
          SELECT *, var_a / n_a AS a, var_b / n_b AS b FROM (
            WITH {SQL_RUNS} SELECT count(value) FILTER (WHERE model = 'view') AS n_a, avg(value) FILTER (WHERE model = 'view') AS mean_a,
              var_samp(value) FILTER (WHERE model = 'view') AS var_a, count(value) FILTER (WHERE model = 'click') AS n_b,
              avg(value) FILTER (WHERE model = 'click') AS mean_b, var_samp(value) FILTER (WHERE model = 'click') AS var_b FROM runs))) w2),
area AS (SELECT sum(CASE WHEN r.k IN (0, 20000) THEN 1 WHEN r.k % 2 = 1 THEN 4 ELSE 2 END
                    * pow(1 + pow(abs(t) * r.k / 20000, 2) / v, -(v + 1) / 2)) * abs(t) / 60000
                  * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) AS x FROM e, range(0, 20001) AS r(k) GROUP BY t, v)
SELECT run_a, run_b, n_a, n_b, mean_a, mean_b, var_a, var_b, t_stat, dof, round(1 - 2 * x, 6) AS p_value FROM e, area""")
def q_welch_pvalue(spark, sf):
    w = welch_pvalue(_runs(spark, sf, ("view", "click")), "model", "value", "view", "click")
    return _round_stats(w, {"mean_a", "mean_b", "var_a", "var_b", "t_stat", "dof", "p_value"})


@query("box_summary", f"""
WITH {SQL_RUNS},
q AS (SELECT model, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM runs GROUP BY model),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.model, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr,
       round(min(r.value) FILTER (WHERE r.value BETWEEN f.lo AND f.hi), 6) AS whisker_low,
       round(max(r.value) FILTER (WHERE r.value BETWEEN f.lo AND f.hi), 6) AS whisker_high,
       count(r.value) FILTER (WHERE NOT (r.value BETWEEN f.lo AND f.hi)) AS n_outliers
FROM f JOIN runs r USING (model)
GROUP BY f.model, f.n, f.q1, f.median, f.q3, f.iqr
""")
def q_box_summary(spark, sf):
    b = box_summary(_all_runs(spark, sf), "model", "value")
    return _round_stats(b.select("model", "n", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high",
                                 "n_outliers"),
                        {"q1", "median", "q3", "iqr", "whisker_low", "whisker_high"})
