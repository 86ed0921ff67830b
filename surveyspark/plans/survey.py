"""Bindings: codebook decoding and prompt building.

The provided tables carry no survey, so a codebook and a wide answers sheet are
derived from them with SQL that both Spark and DuckDB run unchanged:
nation/region/orders/supplier give the questions and options (the supplier
question grows with the data), customer the respondents.
The operators under test then run through the DataFrame API on top.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.chat import CHAT_SYSTEM, chat_dataset
from ..operators.codebook import (answers_long, codebook_options, decode_answers, forward_fill, question_labels,
                                  question_types)
from ..operators.summarize import extract_fields, prompt_completion_pairs, respondent_summary, sectioned_prompt
from ..session import checkpoint_dir, cut_lineage
from ..sources.tables import register_views
from .common import t
from .registry import query

CODEBOOK_SQL = """
SELECT CAST(0 AS BIGINT) AS row_no, 'Q1' AS question, 'Single Select' AS type, 'S01: Nation' AS name,
       CAST(NULL AS STRING) AS value, 'Nation of the customer' AS label
UNION ALL SELECT CAST(1 + n_nationkey AS BIGINT), NULL, NULL, NULL,
       CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS STRING) || '.0' ELSE CAST(n_nationkey AS STRING) END,
       n_name FROM nation
UNION ALL SELECT CAST(100 AS BIGINT), 'Q2', 'Dropdown', 'S02: Region', NULL, NULL
UNION ALL SELECT CAST(101 + r_regionkey AS BIGINT), NULL, NULL, NULL, CAST(r_regionkey AS STRING), r_name FROM region
UNION ALL SELECT CAST(110 + r_regionkey AS BIGINT), NULL, NULL, NULL, CAST(r_regionkey AS STRING), lower(r_name)
       FROM region WHERE r_regionkey = 0
UNION ALL SELECT CAST(200 AS BIGINT), 'Q3', 'Open Text', 'S03: Segment', NULL, 'Market segment'
UNION ALL SELECT CAST(300 AS BIGINT), 'Q4', 'Number Input', 'S04: Balance', NULL, 'Account balance'
UNION ALL SELECT CAST(400 AS BIGINT), 'Q5', 'Rating Scale', 'S05: Rating', NULL, 'Rating of the region'
UNION ALL SELECT CAST(401 + r_regionkey AS BIGINT), NULL, NULL, NULL, CAST(r_regionkey AS STRING), 'level ' || r_name
       FROM region
UNION ALL SELECT CAST(500 AS BIGINT), 'Q6', 'Multiple Select', 'S06: Priorities', NULL, 'Order priorities used'
UNION ALL SELECT CAST(510 + 2 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS BIGINT),
       'Q6.' || substr(o_orderpriority, 1, 1), 'Multiple Select', NULL, NULL, 'Priority ' || o_orderpriority
       FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT CAST(511 + 2 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS BIGINT), NULL, NULL, NULL, '1',
       o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT CAST(600 AS BIGINT), 'Q7', 'Single Matrix', 'S07: Matrix', NULL, 'Matrix of guesses'
UNION ALL SELECT CAST(610 AS BIGINT), 'Q7.1', 'Single Select', NULL, NULL, 'Region guess'
UNION ALL SELECT CAST(611 + r_regionkey AS BIGINT), NULL, NULL, NULL, CAST(r_regionkey AS STRING), r_name
       FROM region WHERE r_regionkey < 2
UNION ALL SELECT CAST(700 AS BIGINT), 'Q8', 'Ranking', 'S08: Rank', NULL, 'Rank of the nation'
UNION ALL SELECT CAST(800 AS BIGINT), 'Q9', 'Net Promoter Score®', 'S09: NPS', NULL, NULL
UNION ALL SELECT CAST(850 AS BIGINT), 'Q11', NULL, 'S11: Late', NULL, 'Type on a later row'
UNION ALL SELECT CAST(851 + n_regionkey AS BIGINT), NULL, 'Single Select', NULL, CAST(n_regionkey AS STRING),
       'late ' || CAST(n_regionkey AS STRING) FROM (SELECT DISTINCT n_regionkey FROM nation)
UNION ALL SELECT CAST(860 AS BIGINT), 'Q12', 'Number Input', 'S12: Number', NULL, 'A number that may be missing'
UNION ALL SELECT CAST(900 AS BIGINT), 'Q10', 'Dropdown', 'S10: Supplier', NULL, 'Preferred supplier'
UNION ALL SELECT CAST(901 + s_suppkey AS BIGINT), NULL, NULL, NULL, CAST(s_suppkey AS STRING), s_name FROM supplier
"""

WIDE_SQL = """
SELECT CAST(c.c_custkey AS STRING) AS pid,
       CAST(c.c_nationkey AS STRING) AS Q1,
       CAST(n.n_regionkey AS STRING) || '.0' AS Q2,
       c.c_mktsegment AS Q3,
       CASE WHEN c.c_acctbal < 0 THEN NULL ELSE CAST(CAST(c.c_acctbal AS DECIMAL(12, 2)) AS STRING) END AS Q4,
       CAST(c.c_nationkey % 7 AS STRING) AS Q5,
       CAST(o.p1 AS STRING) AS Q6_1, CAST(o.p2 AS STRING) AS Q6_2, CAST(o.p3 AS STRING) AS Q6_3,
       CAST(o.p4 AS STRING) AS Q6_4, CAST(o.p5 AS STRING) AS Q6_5,
       CAST(c.c_nationkey % 3 AS STRING) AS Q7_1,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'n/a' ELSE CAST(c.c_nationkey % 4 + 1 AS STRING) END AS Q8,
       CAST(c.c_nationkey * 7 % 11 AS STRING) AS Q9,
       CAST(c.c_custkey % 131 AS STRING) AS Q10,
       CASE WHEN c.c_custkey % 7 = 0 THEN '1e30' WHEN c.c_custkey % 7 = 1 THEN 'Infinity'
            WHEN c.c_custkey % 7 = 2 THEN 'n/a' ELSE CAST(n.n_regionkey AS STRING) END AS Q11,
       CASE WHEN c.c_custkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c.c_custkey % 4 = 1 THEN NULL
            ELSE CAST(c.c_nationkey AS DOUBLE) END AS Q12,
       c.c_acctbal AS Weight
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey,
                  max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS p1,
                  max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS p2,
                  max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS p3,
                  max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS p4,
                  max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS p5
           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

# column of the wide sheet -> question id (dotted ids cannot be plain SQL names)
WIDE_QIDS = ["Q1", "Q2", "Q3", "Q4", "Q5", "Q6.1", "Q6.2", "Q6.3", "Q6.4", "Q6.5", "Q7.1", "Q8", "Q9", "Q10", "Q11", "Q12"]


def survey_codebook(spark, sf):
    register_views(spark, sf, ("nation", "region", "orders", "supplier"))
    return spark.sql(CODEBOOK_SQL)


def survey_answers(spark, sf):
    """Wide answers sheet: pid, Q1..Q9 (with dotted ids), Weight."""
    register_views(spark, sf, ("customer", "nation", "orders"))
    w = spark.sql(WIDE_SQL)
    return w.withColumnsRenamed({q.replace(".", "_"): q for q in WIDE_QIDS if "." in q})


def _canon(x: str) -> str:
    return (f"coalesce(CAST(TRY_CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS BIGINT) AS VARCHAR), trim({x}))")


SQL_CB = f"""cb AS ({CODEBOOK_SQL}),
cbf AS (
  SELECT row_no, last_value(question IGNORE NULLS) OVER w AS question, last_value(type IGNORE NULLS) OVER w AS type,
         last_value(name IGNORE NULLS) OVER w AS name, value, label
  FROM cb WINDOW w AS (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
opts AS (
  SELECT qid, code, label FROM (
    SELECT question AS qid, {_canon('value')} AS code, trim(label) AS label,
           row_number() OVER (PARTITION BY question, {_canon('value')} ORDER BY row_no DESC) AS rn
    FROM cbf WHERE value IS NOT NULL AND label IS NOT NULL) WHERE rn = 1),
qlast AS (SELECT qid, vlabel FROM (SELECT question AS qid, label AS vlabel,
          row_number() OVER (PARTITION BY question ORDER BY row_no DESC) AS rn FROM cbf WHERE value IS NULL) WHERE rn = 1),
qname AS (SELECT qid, fname FROM (SELECT question AS qid, name AS fname,
          row_number() OVER (PARTITION BY question ORDER BY row_no) AS rn FROM cbf WHERE name IS NOT NULL) WHERE rn = 1),
llast AS (SELECT qid, last_label FROM (SELECT question AS qid, label AS last_label,
          row_number() OVER (PARTITION BY question ORDER BY row_no DESC) AS rn FROM cbf WHERE label IS NOT NULL) WHERE rn = 1),
qtyp AS (SELECT qid, qtype FROM (SELECT question AS qid, type AS qtype,
          row_number() OVER (PARTITION BY question ORDER BY row_no DESC) AS rn FROM cbf WHERE type IS NOT NULL) WHERE rn = 1),
qinfo AS (
  SELECT q.qid, qtyp.qtype, coalesce(qlast.vlabel, qname.fname) AS qlabel, llast.last_label
  FROM (SELECT DISTINCT question AS qid FROM cbf) q
  LEFT JOIN qtyp USING (qid) LEFT JOIN qlast USING (qid) LEFT JOIN qname USING (qid) LEFT JOIN llast USING (qid))"""

SQL_LONG = "wide AS ({wide}),\nlong AS (SELECT * FROM (\n{parts}) WHERE value IS NOT NULL)".format(
    wide=WIDE_SQL,
    parts="\n  UNION ALL ".join(
        f"SELECT pid, CAST({i + 1} AS BIGINT) AS pos, '{q}' AS qid, "
        + ("CASE WHEN isnan(Q12) THEN NULL ELSE CAST(Q12 AS VARCHAR) END" if q == "Q12" else q.replace('.', '_'))
        + " AS value FROM wide"
        for i, q in enumerate(WIDE_QIDS)))

SQL_DEC = f"""dec AS (
  SELECT l.pid, l.pos, l.qid, l.value, coalesce(qi.qtype, '') AS qtype, coalesce(qi.qlabel, l.qid) AS qlabel,
         qi.last_label, o.label AS opt_label, split_part(l.qid, '.', 1) AS main
  FROM long l LEFT JOIN qinfo qi ON qi.qid = l.qid
  LEFT JOIN opts o ON o.qid = l.qid AND o.code = {_canon('l.value')}),
dec2 AS (
  SELECT *, CASE WHEN contains(qid, '.') THEN
                   CASE WHEN qtype IN ('Single Select', 'Dropdown', 'Rating Scale', 'Single Matrix', 'Rating Matrix')
                        THEN coalesce(opt_label, '(Unknown code ' || value || ')') ELSE value END
                 WHEN qtype IN ('Single Select', 'Dropdown') THEN coalesce(opt_label, '(Unknown code ' || value || ')')
                 WHEN qtype = 'Rating Scale' THEN coalesce(opt_label, '(Unknown rating ' || value || ')')
                 WHEN qtype IN ('Single Matrix', 'Rating Matrix') THEN coalesce(opt_label, '(Unknown response ' || value || ')')
                 WHEN qtype IN ('Number Input', 'Net Promoter Score®') THEN value
                 WHEN qtype = 'Open Text' THEN '"' || value || '"'
                 WHEN qtype = 'Ranking' THEN CASE WHEN TRY_CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) IS NOT NULL
                        THEN 'Rank ' || CAST(TRY_CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR)
                        ELSE '(invalid rank)' END
                 ELSE value END AS answer
  FROM dec)"""

SQL_SUMMARY = f"""{SQL_CB},
{SQL_LONG},
{SQL_DEC},
m AS (SELECT d.*, coalesce(ml.qlabel, d.main) AS mlabel FROM dec2 d LEFT JOIN qinfo ml ON ml.qid = d.main),
items AS (
  SELECT pid, pos, main, mlabel,
         CASE WHEN qtype = 'Multiple Select' THEN 1 WHEN contains(qid, '.') THEN 2 ELSE 0 END AS sec,
         CASE WHEN qtype = 'Multiple Select' THEN coalesce(opt_label, last_label, qlabel)
              WHEN contains(qid, '.') THEN '  - ' || qid || ' (' || qlabel || '): ' || answer
              ELSE '- ' || qid || ' (' || qlabel || '): ' || answer END AS item
  FROM m WHERE qtype <> 'Multiple Select' OR TRY_CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) = 1),
grp AS (SELECT pid, main, sec, min(pos) AS gpos, any_value(mlabel) AS mlabel FROM items WHERE sec > 0
        GROUP BY pid, main, sec),
lines AS (
  SELECT pid, 0 AS sec, pos AS gpos, CAST(0 AS BIGINT) AS sub, item AS line FROM items WHERE sec = 0
  UNION ALL
  SELECT i.pid, 1, g.gpos, 0, '- ' || i.main || ' (' || g.mlabel || '): ' || string_agg(i.item, ', ' ORDER BY i.pos)
  FROM items i JOIN grp g USING (pid, main, sec) WHERE i.sec = 1 GROUP BY i.pid, i.main, g.gpos, g.mlabel
  UNION ALL
  SELECT pid, 2, gpos, -1, main || ' (' || mlabel || '):' FROM grp WHERE sec = 2
  UNION ALL
  SELECT i.pid, 2, g.gpos, i.pos, i.item FROM items i JOIN grp g USING (pid, main, sec) WHERE i.sec = 2),
body AS (SELECT pid, string_agg(line, chr(10) ORDER BY sec, gpos, sub) AS body FROM lines GROUP BY pid),
summary AS (
  SELECT w.pid, 'Participant Summary:' || chr(10) || CASE WHEN b.body IS NULL THEN '' ELSE b.body || chr(10) END
                || 'Answer summary complete.' AS prompt
  FROM wide w LEFT JOIN body b USING (pid))"""


# --- W1 forward fill -----------------------------------------------------------

@query("forward_fill", """
SELECT event_id, user_id,
       last_value(CASE WHEN event_type = 'error' THEN NULL ELSE value END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events
""")
def q_forward_fill(spark, sf):
    ev = t(spark, sf, "events").select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"))
    # bucket by day: a user with a third of all events is still filled by many tasks
    out = forward_fill(ev, ["value"], ["ts", "event_id"], ["user_id"], bucket=F.to_date("ts"))
    return out.select("event_id", "user_id", "value")


# --- X1-X3 -----------------------------------------------------------------------

@query("codebook_options", f"WITH {SQL_CB} SELECT qid, code, label FROM opts")
def q_codebook_options(spark, sf):
    return codebook_options(survey_codebook(spark, sf))


@query("question_labels", f"WITH {SQL_CB} SELECT qid, qlabel, last_label FROM qinfo")
def q_question_labels(spark, sf):
    return question_labels(survey_codebook(spark, sf))


@query("question_types", f"WITH {SQL_CB} SELECT qid, qtype FROM qinfo")
def q_question_types(spark, sf):
    return question_types(survey_codebook(spark, sf))


# --- P10, X1 on answers -------------------------------------------------------------

@query("answers_long", f"WITH {SQL_LONG} SELECT pid, pos, qid, value FROM long")
def q_answers_long(spark, sf):
    return answers_long(survey_answers(spark, sf))


@query("decode_answers", f"""WITH {SQL_CB},
{SQL_LONG},
{SQL_DEC}
SELECT pid, pos, qid, value, qtype, qlabel, answer FROM dec2""")
def q_decode_answers(spark, sf):
    d = decode_answers(answers_long(survey_answers(spark, sf)), survey_codebook(spark, sf))
    return d.select("pid", "pos", "qid", "value", "qtype", "qlabel", "answer")


# --- T1 ------------------------------------------------------------------------------

@query("respondent_summary", f"WITH {SQL_SUMMARY} SELECT pid, prompt FROM summary")
def q_respondent_summary(spark, sf):
    return respondent_summary(survey_answers(spark, sf), survey_codebook(spark, sf))


# --- F1, T2, D1 on the summaries ---------------------------------------------------------

# Fixed values for this binding: a 2-group, 5-field template over the summary lines.
INTRO = "Eine Person hat folgende Angaben gemacht."
FIELDS = {
    "nation": r"Q1 \(Nation.*",
    "region": r"Q2 \(S02.*",
    "segment": r"Q3 \(Market.*",
    "balance": r"Q4 \(Account.*",
    "rank": r"Q8 \(Rank.*",
}
CONFIG = [
    ("Herkunft", [(FIELDS["nation"], "lebt in {}"), (FIELDS["region"], "Region {}")]),
    ("Konto", [(FIELDS["segment"], "Segment {}"), (FIELDS["balance"], "Saldo {}"), (FIELDS["rank"], "Rang: {}"),
               (FIELDS["balance"], "von {} bis {}")]),
]
COMPLETION = r"Q5 \(Rating.*"


def _sql_field(pat: str) -> str:
    v = rf"regexp_replace(regexp_extract(prompt, '- {pat}\):\s*(.+)', 1), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN lower({v}) IN ('keine angabe', 'weiß ich nicht', 'nan', '') THEN NULL ELSE {v} END"


def _sql_section(group, fields):
    # a template with two placeholders cannot take one value: the value follows it
    whole = lambda tpl: tpl if tpl.count("{}") < 2 else tpl.replace("{}", "{ }") + " {}"
    sents = [f"'{whole(tpl).replace('{}', chr(39) + ' || ' + _sql_field(pat) + ' || ' + chr(39)).replace('{ }', '{}')}'"
             for pat, tpl in fields]
    any_hit = " OR ".join(f"{_sql_field(pat)} IS NOT NULL" for pat, _ in fields)
    return f"CASE WHEN {any_hit} THEN '{group}:' || chr(10) || concat_ws(', ', {', '.join(sents)}) || '.' END"


SQL_PROMPT = "concat_ws(chr(10) || chr(10), '{intro}', {secs})".format(
    intro=INTRO, secs=", ".join(_sql_section(g, f) for g, f in CONFIG))


def _summaries(spark, sf):
    return respondent_summary(survey_answers(spark, sf), survey_codebook(spark, sf))


@query("extract_fields", f"WITH {SQL_SUMMARY} SELECT pid, "
       + ", ".join(f"{_sql_field(p)} AS {n}" for n, p in FIELDS.items()) + " FROM summary")
def q_extract_fields(spark, sf):
    return extract_fields(_summaries(spark, sf), "prompt", FIELDS).drop("prompt")


@query("sectioned_prompt", f"WITH {SQL_SUMMARY} SELECT pid, {SQL_PROMPT} AS prompt FROM summary")
def q_sectioned_prompt(spark, sf):
    return sectioned_prompt(_summaries(spark, sf), "prompt", CONFIG, INTRO, out="section_prompt") \
        .select("pid", F.col("section_prompt").alias("prompt"))


@query("prompt_completion_pairs", f"""WITH {SQL_SUMMARY},
pc AS (SELECT pid, {SQL_PROMPT} AS prompt, {_sql_field(COMPLETION)} AS completion FROM summary)
SELECT pid, prompt, completion FROM pc WHERE completion IS NOT NULL""")
def q_prompt_completion_pairs(spark, sf):
    return prompt_completion_pairs(_summaries(spark, sf), "prompt", CONFIG, INTRO, COMPLETION, keys=["pid"])


SQL_PAIRS_OF_SUMMARY = f"""{SQL_SUMMARY},
pc AS (SELECT pid, {SQL_PROMPT} AS prompt, {_sql_field(COMPLETION)} AS completion FROM summary)"""


# --- the whole chain: answers -> summary -> prompt -> chat records -> split ----------------

@query("survey_to_chat_dataset", f"""WITH {SQL_PAIRS_OF_SUMMARY},
k AS (SELECT *, md5('42|' || pid) AS h FROM pc WHERE completion IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY h, pid) AS rn, count(*) OVER () AS n FROM k)
SELECT pid, CASE WHEN rn <= floor(0.9 * n) THEN 'train' ELSE 'validation' END AS split, '{CHAT_SYSTEM}' AS system_content,
       prompt AS user_content, completion AS assistant_content FROM r""")
def q_survey_to_chat_dataset(spark, sf):
    pairs = prompt_completion_pairs(_summaries(spark, sf), "prompt", CONFIG, INTRO, COMPLETION, keys=["pid"])
    d = chat_dataset(cut_lineage(pairs), "pid")
    return d.select("pid", "split", *[F.col("messages")[i]["content"].alias(f"{who}_content")
                                      for i, who in enumerate(("system", "user", "assistant"))])


# --- files out and in ---------------------------------------------------------------------

@query("prompt_pairs_jsonl_roundtrip", f"""WITH {SQL_PAIRS_OF_SUMMARY}
SELECT pid, prompt, completion FROM pc WHERE completion IS NOT NULL""")
def q_prompt_pairs_jsonl_roundtrip(spark, sf):
    """Prompt pairs written as JSON lines and read back."""
    pairs = prompt_completion_pairs(_summaries(spark, sf), "prompt", CONFIG, INTRO, COMPLETION, keys=["pid"])
    path = f"{checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    pairs.write.json(path)
    return spark.read.schema(pairs.schema).json(path)


@query("summaries_csv_roundtrip", f"WITH {SQL_SUMMARY} SELECT pid, prompt FROM summary")
def q_summaries_csv_roundtrip(spark, sf):
    """Summaries (texts with line breaks, quotes and commas) written as CSV and read back."""
    d = _summaries(spark, sf)
    path = f"{checkpoint_dir(spark)}/summaries-{uuid.uuid4().hex}"
    d.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return spark.read.schema(d.schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
