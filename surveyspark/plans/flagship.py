"""Flagship question: which conversations are answered closer to the question?"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compare import mean_by_run
from ..operators.score import tfidf_pair_cosine
from .common import conversation_pairs, r6, t
from .registry import query

SQL_FLAGSHIP = """
WITH {pairs},
{cos},
sys AS (SELECT conv_id, bool_or(role = 'system') AS has_system FROM conversations GROUP BY conv_id)
SELECT CASE WHEN has_system THEN 'with_system' ELSE 'plain' END AS model,
       count(*) AS n, round(avg(cosine_similarity), 6) AS mean_cosine_similarity
FROM cos JOIN sys USING (conv_id)
GROUP BY 1
"""


def flagship(spark, sf):
    conv = t(spark, sf, "conversations")
    cos = tfidf_pair_cosine(conversation_pairs(conv), ["conv_id", "turn"], "text_a", "text_b")
    runs = conv.groupBy("conv_id").agg(
        F.when(F.max((F.col("role") == "system").cast("int")) == 1, "with_system").otherwise("plain").alias("model"))
    m = mean_by_run(cos.join(runs, "conv_id"), "model", ["cosine_similarity"])
    return m.select("model", "n", r6("mean_cosine_similarity").alias("mean_cosine_similarity"))


def _sql():
    from .common import SQL_PAIRS, sql_pair_cosine
    return SQL_FLAGSHIP.format(pairs=SQL_PAIRS, cos=sql_pair_cosine("pairs", "conv_id, turn"))


query("pair_scores_by_run", _sql())(flagship)
