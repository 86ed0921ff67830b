"""Bindings: attribution to requests (M4b, W3, T3, T4, W2, S7, K5, F10), and scored texts
(F12, X4, A12, A14) over the conversations and documents.

orders are the examples (their line items aggregated into features), the three
order states the classes, and a linear score with fixed weights per class the model.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import strip_prompt, tokens
from ..operators.attribution import (attribution_text, document_lines, explode_attribution_json, explode_attrs,
                                     linear_attribution, parse_attribution_text, read_attribution_document,
                                     to_json_lines, top_features, top_n)
from ..operators.broadcast import stored
from ..operators.compare import mean_by_run
from ..operators.generate import SYSTEM_MESSAGE, explanation_request, head_per_group
from ..operators.keywords import find_keywords
from ..operators.score import features_with_synonyms, keyword_coverage, synonym_expand, tfidf_pair_cosine
from ..session import checkpoint_dir, cut_lineage
from ..sources.named_files import write_named_files
from .common import SQL_PAIRS, SQL_TOKENS, conversation_pairs, r6, sql_pair_cosine, t
from .registry import query

FEATURES = ["o_totalprice", "n_lines", "max_discount", "max_tax"]
# Fixed values for this binding: weights of the linear score per class.
WEIGHTS = {
    "F": {"o_totalprice": 0.00137, "n_lines": 1.731, "max_discount": -23.17, "max_tax": 41.3},
    "O": {"o_totalprice": -0.00091, "n_lines": -0.583, "max_discount": 31.7, "max_tax": -9.71},
    "P": {"o_totalprice": 0.00053, "n_lines": 0.917, "max_discount": 12.9, "max_tax": 27.3},
}
HEAD_N = 100


def examples(spark, sf, *carry):
    """One row per order: its total price, features of its line items and the columns ``carry`` of the order."""
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.max("l_discount").alias("max_discount"),
        F.max("l_tax").alias("max_tax"))
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", *carry)
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(
        F.col("o_orderkey").alias("example_index"), *FEATURES, *carry)


def nested(spark, sf):
    return linear_attribution(examples(spark, sf), "example_index", FEATURES, WEIGHTS, nested=True)


_W_VALUES = ", ".join(
    f"('{c}', " + ", ".join(f"CAST({w[f]} AS DOUBLE)" for f in FEATURES) + ")" for c, w in WEIGHTS.items())
SQL_EXAMPLES = """li AS (
  SELECT o.o_orderkey AS example_index, o.o_totalprice, CAST(l.n_lines AS DOUBLE) AS n_lines, l.max_discount, l.max_tax
  FROM orders o JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_discount) AS max_discount, max(l_tax) AS max_tax
                      FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey)"""

SQL_ATTR = f"""{SQL_EXAMPLES},
mu AS (SELECT {', '.join(f'avg({f}) AS m_{f}' for f in FEATURES)} FROM li),
wt AS (SELECT * FROM (VALUES {_W_VALUES}) v(class_label, {', '.join('w_' + f for f in FEATURES)})),
attr AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT wt.class_label, li.example_index, CAST({i} AS BIGINT) AS feature_pos, '{f}' AS feature, "
    f"w_{f} * ({f} - m_{f}) AS value FROM li, mu, wt" for i, f in enumerate(FEATURES)) + ")"

SQL_TOP = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class_label, example_index ORDER BY abs(value) DESC, feature_pos) AS rnk
  FROM attr)"""

SQL_TEXT = f"""{SQL_TOP},
txt AS (
  SELECT class_label, example_index,
         'The most important features are: ' || string_agg('"' || replace(feature, '_', ' ') || '" with '
           || printf('%.2f', value) || ' (' || CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END || ')',
           ', ' ORDER BY rnk) || '.' AS shap_text
  FROM ranked WHERE rnk <= 10 GROUP BY class_label, example_index)"""

SYSTEM = SYSTEM_MESSAGE.replace("'", "''")
SQL_REQ = f"""{SQL_TEXT},
req AS (
  SELECT class_label, example_index, shap_text,
         'Here are the most important features for an example:' || chr(10) || chr(10) || shap_text || chr(10) || chr(10)
           || 'Please explain in simple terms how these features affect the prediction.' AS user_content
  FROM txt)"""


@query("linear_attribution", f"""WITH {SQL_ATTR}
SELECT class_label, example_index, feature_pos, feature, round(value, 6) AS value FROM attr""")
def q_linear_attribution(spark, sf):
    a = explode_attrs(nested(spark, sf))
    return a.select("class_label", "example_index", "feature_pos", "feature", r6("value").alias("value"))


@query("top_features", f"""WITH {SQL_ATTR},
{SQL_TOP}
SELECT class_label, example_index, rnk AS rank, replace(feature, '_', ' ') AS feature, round(value, 6) AS value
FROM ranked WHERE rnk <= 3""")
def q_top_features(spark, sf):
    top = top_features(nested(spark, sf), n=3)
    return top.select("class_label", "example_index", "rank", "feature", r6("value").alias("value"))


@query("attribution_text", f"""WITH {SQL_ATTR},
{SQL_TEXT}
SELECT class_label, example_index, shap_text FROM txt""")
def q_attribution_text(spark, sf):
    return attribution_text(nested(spark, sf)).select("class_label", "example_index", "shap_text")


@query("explanation_request", f"""WITH {SQL_ATTR},
{SQL_REQ}
SELECT class_label, example_index, '{SYSTEM}' AS system_content, user_content,
       '{SYSTEM}' || chr(10) || user_content AS plain_prompt
FROM req""")
def q_explanation_request(spark, sf):
    r = explanation_request(attribution_text(nested(spark, sf)), style="chat")
    r = explanation_request(r, style="plain", out="plain_prompt")
    return r.select("class_label", "example_index", F.col("request")[0]["content"].alias("system_content"),
                    F.col("request")[1]["content"].alias("user_content"), "plain_prompt")


@query("explanation_request_heads", f"""WITH {SQL_ATTR},
{SQL_REQ},
head AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY example_index) AS hn FROM req)
SELECT class_label, example_index, user_content FROM head WHERE hn <= {HEAD_N}""")
def q_explanation_request_heads(spark, sf):
    """The chain as it is run: the first examples per class are picked before any text is built."""
    heads = head_per_group(nested(spark, sf), "class_label", "example_index", HEAD_N)
    r = explanation_request(attribution_text(heads), style="chat")
    return r.select("class_label", "example_index", F.col("request")[1]["content"].alias("user_content"))


@query("strip_prompt", rf"""WITH {SQL_PAIRS}
SELECT conv_id, turn, regexp_replace(text_b, '^\s+|\s+$', '', 'g') AS answer FROM pairs""")
def q_strip_prompt(spark, sf):
    """Answers of the conversations behind their echoed prompts."""
    pairs = conversation_pairs(t(spark, sf, "conversations"))
    echoed = pairs.withColumn("output", F.concat("text_a", F.lit("\n  "), "text_b", F.lit(" \n")))
    return echoed.select("conv_id", "turn", strip_prompt("output", "text_a").alias("answer"))


# Fixed values for this binding: synonyms of frequent words of the texts (some words have none,
# some lists omit the word itself).
SYNONYMS = [("the", "le"), ("the", "DER"), ("of", "von"), ("of", "de"), ("and", "und"), ("and", "and"), ("is", "ist"),
            ("das", "that"), ("que", "that"), ("in", "en"), ("To", "zu")]


def _syn_df(spark):
    return spark.createDataFrame(SYNONYMS, "word string, synonym string")


_SYN_VALUES = ", ".join(f"('{w}', '{s}')" for w, s in SYNONYMS)


def _sql_synonyms(words: str) -> str:
    """CTEs: synonyms of the distinct ``feature`` values of CTE ``words``."""
    return f"""syn AS (SELECT * FROM (VALUES {_SYN_VALUES}) v(word, synonym)),
fsyn AS (
  SELECT f.feature, CASE WHEN count(s.synonym) = 0 THEN [lower(f.feature)]
                         ELSE list_sort(list_distinct(list(lower(s.synonym)) FILTER (WHERE s.synonym IS NOT NULL))) END
                    AS synonyms
  FROM (SELECT DISTINCT feature FROM {words}) f LEFT JOIN syn s ON lower(s.word) = lower(f.feature) GROUP BY f.feature)"""


@query("synonym_expand", f"""WITH w AS (SELECT unnest({SQL_TOKENS.format(x='text')}) AS feature FROM documents),
{_sql_synonyms('w')}
SELECT feature, array_to_string(synonyms, '|') AS synonyms FROM fsyn""")
def q_synonym_expand(spark, sf):
    """Every distinct word of the documents with its synonyms."""
    words = t(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("feature")).distinct()
    s = synonym_expand(words, "feature", _syn_df(spark))
    return s.select("feature", F.array_join("synonyms", "|").alias("synonyms"))


def explained_pairs(spark, sf):
    """User text and answer of the conversations: the words of the one are looked for in the other."""
    p = conversation_pairs(t(spark, sf, "conversations"))
    p = p.withColumn("features", F.array_distinct(tokens(F.col("text_a"))))
    p = features_with_synonyms(p, "features", _syn_df(spark), ["conv_id", "turn"])
    return keyword_coverage(p, "features_with_synonyms", "text_b")


SQL_KEYWORDS = f"""{SQL_PAIRS},
feats AS (SELECT DISTINCT conv_id, turn, feature FROM
          (SELECT conv_id, turn, unnest({SQL_TOKENS.format(x='text_a')}) AS feature FROM pairs)),
{_sql_synonyms('feats')},
hits AS (
  SELECT f.conv_id, f.turn, f.feature, bool_or(contains(lower(p.text_b), s.syn)) AS hit
  FROM feats f JOIN pairs p USING (conv_id, turn) JOIN (SELECT feature, unnest(synonyms) AS syn FROM fsyn) s USING (feature)
  GROUP BY f.conv_id, f.turn, f.feature),
kw AS (SELECT p.conv_id, p.turn, count(*) FILTER (WHERE hit) AS matched, count(feature) AS nfeat
       FROM pairs p LEFT JOIN hits USING (conv_id, turn) GROUP BY p.conv_id, p.turn)"""


@query("explanation_scores", f"""WITH {SQL_KEYWORDS},
{sql_pair_cosine('pairs', 'conv_id, turn')}
SELECT c.conv_id, c.turn, kw.matched AS matched_keyword_count,
       round(CASE WHEN kw.nfeat > 0 THEN kw.matched / kw.nfeat ELSE 0.0 END, 6) AS keyword_accuracy,
       round(c.cosine_similarity, 6) AS cosine_similarity
FROM cos c JOIN kw USING (conv_id, turn)""")
def q_explanation_scores(spark, sf):
    s = explained_pairs(spark, sf)
    cos = tfidf_pair_cosine(conversation_pairs(t(spark, sf, "conversations")), ["conv_id", "turn"], "text_a", "text_b")
    s = s.join(cos, ["conv_id", "turn"])
    return s.select("conv_id", "turn", "matched_keyword_count", r6("keyword_accuracy").alias("keyword_accuracy"),
                    r6("cosine_similarity").alias("cosine_similarity"))


@query("keyword_coverage", f"""WITH {SQL_KEYWORDS}
SELECT conv_id, turn, matched AS matched_keyword_count,
       round(CASE WHEN nfeat > 0 THEN matched / nfeat ELSE 0.0 END, 6) AS keyword_accuracy, nfeat AS n_features FROM kw""")
def q_keyword_coverage(spark, sf):
    s = explained_pairs(spark, sf)
    return s.select("conv_id", "turn", "matched_keyword_count", r6("keyword_accuracy").alias("keyword_accuracy"),
                    F.size("features_with_synonyms").cast("bigint").alias("n_features"))


# --- the whole chain: attribution -> top features -> text -> score -> comparison of runs ----

SQL_CHAIN = f"""WITH {SQL_ATTR},
{SQL_TEXT},
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY example_index) AS hn FROM txt)
         WHERE hn <= {HEAD_N}),
ans AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS dn FROM documents),
pairs AS (SELECT h.class_label, h.example_index, h.shap_text AS text_a, ans.text AS text_b FROM head h JOIN ans ON ans.dn = h.hn),
{sql_pair_cosine('pairs', 'class_label, example_index')},
kw AS (
  SELECT p.class_label, p.example_index,
         avg(CASE WHEN contains(lower(p.text_b), lower(split_part(replace(r.feature, '_', ' '), ' ', 1))) THEN 1.0 ELSE 0.0 END) AS acc
  FROM pairs p JOIN ranked r ON r.class_label = p.class_label AND r.example_index = p.example_index AND r.rnk <= 10
  GROUP BY p.class_label, p.example_index)
SELECT class_label AS model, count(*) AS n, round(avg(cosine_similarity), 6) AS mean_cosine_similarity,
       round(avg(acc), 6) AS mean_keyword_accuracy
FROM cos JOIN kw USING (class_label, example_index) GROUP BY class_label"""


@query("explain_and_compare", SQL_CHAIN)
def q_explain_and_compare(spark, sf):
    """The first explanations per class, each scored against an answer (the documents in order
    stand for the answers), compared by class: cosine and coverage of the features' first words."""
    heads = attribution_text(head_per_group(nested(spark, sf), "class_label", "example_index", HEAD_N))
    w = Window.partitionBy("class_label").orderBy("example_index")
    heads = cut_lineage(heads.withColumn("hn", F.row_number().over(w)))
    answers = t(spark, sf, "documents").select("doc_id", F.col("text").alias("text_b")).orderBy("doc_id").limit(HEAD_N)
    answers = answers.withColumn("hn", F.row_number().over(Window.orderBy("doc_id")))
    p = heads.join(answers, "hn").withColumn("features", F.transform(
        top_n(F.col("attrs"), 10), lambda a: F.split(F.translate(a["feature"], "_", " "), " ")[0]))
    p = cut_lineage(p.select("class_label", "example_index", "shap_text", "text_b", "features"))
    keys = ["class_label", "example_index"]
    own = spark.createDataFrame([], "word string, synonym string")
    k = keyword_coverage(features_with_synonyms(p, "features", own, keys), "features_with_synonyms", "text_b")
    scored = k.join(tfidf_pair_cosine(p, keys, "shap_text", "text_b"), keys).withColumnRenamed("class_label", "model")
    m = mean_by_run(scored, "model", ["cosine_similarity", "keyword_accuracy"])
    return m.select("model", "n", r6("mean_cosine_similarity").alias("mean_cosine_similarity"),
                    r6("mean_keyword_accuracy").alias("mean_keyword_accuracy"))


# --- JSON in and out ----------------------------------------------------------------

@query("attribution_json_roundtrip", f"""WITH {SQL_ATTR}
SELECT class_label, example_index, feature_pos, feature, round(value, 6) AS value FROM attr""")
def q_attribution_json_roundtrip(spark, sf):
    back = explode_attribution_json(to_json_lines(nested(spark, sf)))
    return back.select("class_label", "example_index", "feature_pos", "feature", r6("value").alias("value"))


@query("attribution_document_roundtrip", f"""WITH {SQL_ATTR}
SELECT class_label, example_index, feature_pos, feature, round(value, 6) AS value FROM attr""")
def q_attribution_document_roundtrip(spark, sf):
    """The whole attribution written as one JSON document in one file of the shared checkpoint folder,
    and read back from it in splits."""
    out = f"{checkpoint_dir(spark)}/attribution-{uuid.uuid4().hex}"
    # read for the classes, for the last line, for the borders of the sort and by the writer: stored once
    lines = document_lines(stored(nested(spark, sf))[0]).withColumn("name", F.lit("attribution.json"))
    write_named_files(lines, out, "name", ("class_rank", "example_index"))
    back = read_attribution_document(spark, f"{out}/attribution.json")
    return back.select("class_label", "example_index", "feature_pos", "feature", r6("value").alias("value"))


@query("parse_attribution_text", """
SELECT event_id, 'k' AS "key", CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events""")
def q_parse_attribution_text(spark, sf):
    ev = t(spark, sf, "events")
    # the props are JSON; Python-literal dict text (single quotes) parses the same way
    m = parse_attribution_text(F.regexp_replace("props", '"', "'"))
    return ev.select("event_id", F.explode(m).alias("key", "value"))


# --- many keywords at once ----------------------------------------------------------

@query("keyword_documents", r"""WITH k AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS keyword FROM benchmark)
SELECT keyword, CAST(count(*) AS BIGINT) AS n_documents FROM k, documents WHERE contains(lower(text), keyword) GROUP BY keyword""")
def q_keyword_documents(spark, sf):
    """For every word of the benchmark, the number of documents that hold it as a substring."""
    words = t(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("keyword"))
    hits = find_keywords(t(spark, sf, "documents"), ["doc_id"], "text", words)
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_documents"))
