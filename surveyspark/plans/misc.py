"""Bindings: head per group (W2), aliases and safe names (X5, F8), classification
metrics (A7, A8, A10), sentiment (M5) and keyword coverage of documents (A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators.compare import alias_names
from ..operators.generate import head_per_group
from ..operators.lexicon import learnt_sentiment, word_odds
from ..operators.metrics import accuracy_f1, classification_report, log_loss
from ..operators.score import features_with_synonyms, keyword_coverage
from ..operators.sentiment import fit_sentiment, sentiment_lexicon, sentiment_trained
from .common import r6, t
from .registry import query


@query("head_per_group", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= 100""")
def q_head_per_group(spark, sf):
    return head_per_group(t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query("safe_name", r"""SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_\-]', '_', 'g') AS safe FROM pages""")
def q_safe_name(spark, sf):
    return t(spark, sf, "pages").select("page_id", safe_name("url").alias("safe"))


# Fixed values for this binding: host -> short alias.
ALIASES = [("example.com", "com_site"), ("example.org", "org_site")]


@query("alias_names", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '([a-z]+\.[a-z]+)(/|$|\?|#)', 1) AS host FROM pages),
a AS (SELECT * FROM (VALUES ('example.com', 'com_site'), ('example.org', 'org_site')) v(name, alias))
SELECT p.page_id, p.host, coalesce(a.alias, regexp_replace(p.host, '[^a-zA-Z0-9_\-]', '_', 'g')) AS alias
FROM p LEFT JOIN a ON a.name = p.host""")
def q_alias_names(spark, sf):
    p = t(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"([a-z]+\.[a-z]+)(/|$|\?|#)", 1)
                                     .alias("host"))
    a = spark.createDataFrame(ALIASES, "name string, alias string")
    return alias_names(p, "host", a).select("page_id", "host", "alias")


def predictions(spark, sf):
    """documents with their quality label; prediction = long text, probability =
    logistic of the length."""
    d = t(spark, sf, "documents").select("doc_id", "n_chars")
    lab = t(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    p1 = 1.0 / (1.0 + F.exp(-(F.col("n_chars") - 2000) / 1000.0))
    return j.select("doc_id", F.col("quality").alias("label"),
                    F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("prediction"),
                    F.array(1.0 - p1, p1).alias("probability"))


SQL_PRED = """d AS (
  SELECT l.quality AS label, CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS pred,
         1.0 / (1.0 + exp(-(d.n_chars - 2000) / 1000.0)) AS p1
  FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT CAST(label AS VARCHAR) AS label, CAST(pred AS VARCHAR) AS pred, count(*) AS n FROM d GROUP BY 1, 2),
s AS (SELECT label AS cls, CASE WHEN label = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM c
      UNION ALL SELECT pred, 0, 0, n FROM c),
k AS (SELECT cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
             CAST(sum(predicted) AS BIGINT) AS predicted FROM s GROUP BY cls),
k2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM k),
k3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM k2)"""


@query("classification_report", f"""WITH {SQL_PRED}
SELECT cls AS "class", round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1_score, support FROM k3
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM k3
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM k3
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM k3""")
def q_classification_report(spark, sf):
    r = classification_report(predictions(spark, sf), "label", "prediction")
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), "support")


@query("accuracy_f1", f"""WITH {SQL_PRED}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
       CAST(sum(support) AS BIGINT) AS n FROM k3""")
def q_accuracy_f1(spark, sf):
    a = accuracy_f1(predictions(spark, sf), "label", "prediction")
    return a.select(r6("accuracy").alias("accuracy"), r6("f1_weighted").alias("f1_weighted"), "n")


@query("log_loss", f"""WITH {SQL_PRED}
SELECT round(avg(-ln(greatest(CASE WHEN label = 1 THEN p1 ELSE 1.0 - p1 END, 1e-15))), 6) AS log_loss,
       count(*) AS n FROM d""")
def q_log_loss(spark, sf):
    ll = log_loss(predictions(spark, sf), "label", "probability")
    return ll.select(r6("log_loss").alias("log_loss"), "n")


# Fixed values for this binding: a small multilingual polarity lexicon.
LEXICON = [("und", 1.0), ("nicht", -1.0), ("the", 0.5), ("not", -1.0), ("le", 0.25), ("pas", -1.0),
           ("que", 0.5), ("de", -0.25), ("el", 0.5), ("no", -1.0), ("ist", 0.5), ("des", -0.5)]


@query("sentiment_lexicon", r"""
WITH lex AS (SELECT * FROM (VALUES ('und', 1.0), ('nicht', -1.0), ('the', 0.5), ('not', -1.0), ('le', 0.25),
                                   ('pas', -1.0), ('que', 0.5), ('de', -0.25), ('el', 0.5), ('no', -1.0), ('ist', 0.5),
                                   ('des', -0.5)) v(word, score)),
tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS tok FROM documents),
s AS (SELECT tk.doc_id, sum(CAST(lex.score AS DOUBLE)) AS score FROM tk JOIN lex ON lex.word = tk.tok GROUP BY tk.doc_id)
SELECT d.doc_id, round(coalesce(s.score, 0.0), 6) AS sentiment_score,
       CASE WHEN coalesce(s.score, 0.0) > 0 THEN 'positive' WHEN coalesce(s.score, 0.0) < 0 THEN 'negative'
            ELSE 'neutral' END AS sentiment
FROM documents d LEFT JOIN s USING (doc_id)""")
def q_sentiment_lexicon(spark, sf):
    lex = spark.createDataFrame(LEXICON, "word string, score double")
    s = sentiment_lexicon(t(spark, sf, "documents").select("doc_id", "text"), "text", lex, ["doc_id"])
    return s.select("doc_id", r6("sentiment_score").alias("sentiment_score"), "sentiment")


@query("sentiment_trained")
def q_sentiment_trained(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "text")
    train = docs.join(t(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    model = fit_sentiment(train, "text", "toxic", num_features=1 << 16)
    return sentiment_trained(docs, "text", model, {0: "neutral", 1: "negative"}).select("doc_id", "sentiment")


@query("sentiment_word_odds", r"""
WITH t AS (SELECT DISTINCT doc_id, toxic, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
           FROM documents JOIN labels USING (doc_id)),
n AS (SELECT word, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS n0 FROM t GROUP BY word),
s AS (SELECT *, sum(n1) OVER () AS a1, sum(n0) OVER () AS a0 FROM n),
p AS (SELECT *, 1000.0 * (n1 + n0) / (a1 + a0) AS a FROM s),
o AS (SELECT *, ln((n1 + a) / (a1 + 1000 - n1 - a)) - ln((n0 + a) / (a0 + 1000 - n0 - a)) AS odds FROM p)
SELECT word, n1, n0, round(odds, 6) AS odds, round(odds / sqrt(1 / (n1 + a) + 1 / (n0 + a)), 6) AS z FROM o""")
def q_sentiment_word_odds(spark, sf):
    """Log-odds of every word between toxic and other labelled documents."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    o = word_odds(d, "text", "toxic")
    return o.select("word", "n1", "n0", r6("odds").alias("odds"), r6("z").alias("z"))


@query("sentiment_learnt")
def q_sentiment_learnt(spark, sf):
    """Every document by a lexicon learnt from the labelled ones and spread over neighbouring words."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    train = docs.join(t(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return learnt_sentiment(docs, train, ["doc_id"], "text", "toxic")


# Fixed values for this binding: German keywords with synonym lists (one keyword
# has no entry and falls back to itself).
DE_KEYWORDS = ["und", "nicht", "keit", "heit", "lich"]
DE_SYNONYMS = [("und", "sowie"), ("und", "und"), ("nicht", "kein"), ("keit", "keit"), ("heit", "heiten")]


@query("keyword_coverage_documents", """
WITH syn AS (SELECT * FROM (VALUES ('und', 'sowie'), ('und', 'und'), ('nicht', 'kein'), ('keit', 'keit'),
                                   ('heit', 'heiten')) v(word, synonym)),
kw AS (SELECT * FROM (VALUES ('und'), ('nicht'), ('keit'), ('heit'), ('lich')) v(feature)),
fs AS (SELECT kw.feature, coalesce(list(lower(syn.synonym)) FILTER (WHERE syn.synonym IS NOT NULL), []) AS syns
       FROM kw LEFT JOIN syn ON lower(syn.word) = lower(kw.feature) GROUP BY kw.feature),
fs2 AS (SELECT feature, unnest(CASE WHEN len(syns) = 0 THEN [lower(feature)] ELSE syns END) AS s FROM fs),
hit AS (SELECT d.doc_id, f.feature, bool_or(contains(lower(d.text), f.s)) AS h
        FROM documents d, fs2 f GROUP BY d.doc_id, f.feature)
SELECT doc_id, CAST(count(*) FILTER (WHERE h) AS BIGINT) AS matched_keyword_count,
       round(count(*) FILTER (WHERE h) / 5.0, 6) AS keyword_accuracy
FROM hit GROUP BY doc_id""")
def q_keyword_coverage_documents(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    d = d.withColumn("features", F.array(*[F.lit(k) for k in DE_KEYWORDS]))
    syn = spark.createDataFrame(DE_SYNONYMS, "word string, synonym string")
    d = features_with_synonyms(d, "features", syn, ["doc_id"])
    k = keyword_coverage(d, "features_with_synonyms", "text")
    return k.select("doc_id", "matched_keyword_count", r6("keyword_accuracy").alias("keyword_accuracy"))
