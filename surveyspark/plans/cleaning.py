"""Bindings: column cleaning and category standardisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.clean import (category_codes, drop_named_columns, drop_sparse_columns, encode_categories, fill_defaults,
                               normalize_text, null_profile, rename_by_dictionary, split_target)
from ..operators.standardize import standardize_categories
from ..session import checkpoint_dir
from ..sources.lookups import read_name_map, read_template_config, read_term_lines, read_term_list, write_term_lines
from .common import r6, t
from .registry import query


def events_with_nulls(spark, sf):
    """events with ``value`` missing on errors and ``props`` kept only for signups."""
    ev = t(spark, sf, "events")
    return ev.select(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") != "signup", F.lit(None).cast("string")).otherwise(F.col("props")).alias("props"))


SQL_EV = """ev AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
         CASE WHEN event_type <> 'signup' THEN NULL ELSE props END AS props
  FROM events)"""


@query("null_profile", f"""
WITH {SQL_EV},
c AS (SELECT count(*) AS n, count(event_id) AS c0, count(user_id) AS c1, count(event_type) AS c2,
             count(value) AS c3, count(props) AS c4 FROM ev)
SELECT pos, "column", n AS n_rows, n - cnt AS n_null, round(100.0 * (n - cnt) / n, 6) AS null_pct
FROM (SELECT CAST(0 AS BIGINT) AS pos, 'event_id' AS "column", c0 AS cnt, n FROM c UNION ALL
      SELECT 1, 'user_id', c1, n FROM c UNION ALL SELECT 2, 'event_type', c2, n FROM c UNION ALL
      SELECT 3, 'value', c3, n FROM c UNION ALL SELECT 4, 'props', c4, n FROM c)
""")
def q_null_profile(spark, sf):
    p = null_profile(events_with_nulls(spark, sf))
    return p.select("pos", "column", "n_rows", "n_null", r6("null_pct").alias("null_pct"))


@query("drop_sparse_columns", f"WITH {SQL_EV} SELECT event_id, user_id, event_type, value FROM ev")
def q_drop_sparse_columns(spark, sf):
    return drop_sparse_columns(events_with_nulls(spark, sf), 50)


@query("split_target", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer
UNION ALL SELECT c_custkey, NULL, NULL, NULL, c_mktsegment FROM customer
""")
def q_split_target(spark, sf):
    """Both halves: the features, and the target with its key."""
    x, y = split_target(t(spark, sf, "customer"), "c_mktsegment", key="c_custkey")
    return x.unionByName(y, allowMissingColumns=True)


@query("drop_named_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_drop_named_columns(spark, sf):
    return drop_named_columns(t(spark, sf, "customer"), ["c_name", "c_phone", "c_comment"])


RENAMES = {"c_custkey": "key", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "balance"}


@query("rename_by_dictionary", """
SELECT c_custkey AS "key", c_name AS name, c_nationkey, c_acctbal AS balance,
       c_mktsegment AS balance__c_mktsegment FROM customer
""")
def q_rename_by_dictionary(spark, sf):
    return rename_by_dictionary(t(spark, sf, "customer"), RENAMES)


@query("fill_defaults", f"""
WITH {SQL_EV}
SELECT event_id, user_id, event_type, coalesce(value, 99.0) AS value, coalesce(props, 'keine angabe') AS props
FROM ev
""")
def q_fill_defaults(spark, sf):
    return fill_defaults(events_with_nulls(spark, sf), {"value": 99, "props": "keine angabe"})


def part_messy_names(spark, sf):
    p = t(spark, sf, "part")
    raw = (F.when(F.col("p_size") < 25, F.concat(F.lit("\t"), F.upper("p_name"), F.lit("  ")))
            .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\n"))))
    return p.select("p_partkey", raw.alias("p_name"))


@query("normalize_text", r"""
SELECT p_partkey, regexp_replace(lower(CASE WHEN p_size < 25 THEN chr(9) || upper(p_name) || '  '
                                            ELSE ' ' || p_name || chr(10) END), '^\s+|\s+$', '', 'g') AS p_name
FROM part
""")
def q_normalize_text(spark, sf):
    return normalize_text(part_messy_names(spark, sf), ["p_name"])


@query("encode_categories", """
WITH d AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_code
           FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL))
SELECT c.c_custkey, c.c_mktsegment, coalesce(d.c_mktsegment_code, -1) AS c_mktsegment_code
FROM customer c LEFT JOIN d USING (c_mktsegment)
""")
def q_encode_categories(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode_categories(c, ["c_mktsegment"])


def part_typo_names(spark, sf):
    """p_name with typos, case changes, rule words and missing values."""
    p = t(spark, sf, "part")
    m = F.col("p_size") % 5
    raw = (F.when(F.col("p_size") == 50, F.lit(None).cast("string"))
            .when(m == 0, F.regexp_replace("p_name", "e", "a"))
            .when(m == 1, F.concat(F.upper("p_name"), F.lit(" xx")))
            .when(m == 2, F.concat(F.lit("Techniker "), F.col("p_name")))
            .when(m == 3, F.concat(F.col("p_name"), F.lit(" and a much longer tail")))
            .otherwise(F.col("p_name")))
    return p.select("p_partkey", raw.alias("raw"))


def part_dictionary(spark, sf):
    return t(spark, sf, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("pos"))


SQL_STD = """
WITH p AS (
  SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL
                         WHEN p_size % 5 = 0 THEN replace(p_name, 'e', 'a')
                         WHEN p_size % 5 = 1 THEN upper(p_name) || ' xx'
                         WHEN p_size % 5 = 2 THEN 'Techniker ' || p_name
                         WHEN p_size % 5 = 3 THEN p_name || ' and a much longer tail'
                         ELSE p_name END AS raw
  FROM part),
dict AS (SELECT p_name AS term, min(p_partkey) AS pos FROM part GROUP BY p_name),
vals AS (SELECT DISTINCT raw, lower(raw) AS low FROM p WHERE raw IS NOT NULL),
sc AS (SELECT v.raw, v.low, d.term, d.pos,
              CASE WHEN greatest(length(v.low), length(d.term)) = 0 THEN 100.0
                   ELSE 100.0 * (1.0 - levenshtein(v.low, d.term) / greatest(length(v.low), length(d.term))) END AS score
       FROM vals v CROSS JOIN dict d),
best AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, pos) AS rn FROM sc),
lut AS (SELECT raw, CASE WHEN instr(low, 'techniker') > 0 THEN 'tk'
                         WHEN instr(low, 'dak gesundheit') > 0 THEN 'dak'
                         WHEN instr(low, 'a0k') > 0 THEN 'aok'
                         WHEN score >= 70 THEN term ELSE low END AS std
        FROM best WHERE rn = 1)
SELECT p.p_partkey, p.raw, CASE WHEN p.raw IS NULL THEN 'keine angabe' ELSE lut.std END AS std
FROM p LEFT JOIN lut USING (raw)
"""


@query("standardize_categories", SQL_STD)
def q_standardize_categories(spark, sf):
    return standardize_categories(part_typo_names(spark, sf), "raw", part_dictionary(spark, sf), 70.0, out="std")


# --- lookup files (S9): written from the tables, read back by their readers ---------------

@query("split_target_int", """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS p_size FROM part""")
def q_split_target_int(spark, sf):
    """A target written as text with a fraction, or as no number, cast to a whole number."""
    size = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5")))
    _x, y = split_target(t(spark, sf, "part").withColumn("p_size", size), "p_size", key="p_partkey", as_int=True)
    return y


@query("template_config_roundtrip", """
SELECT n_regionkey AS group_pos, r_name AS "group", n_nationkey AS field_pos, '^' || n_name || '("|,)' AS pattern,
       'My "nation",' || chr(10) || n_name || ': {}' AS template
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def q_template_config_roundtrip(spark, sf):
    """A prompt template per nation, written as CSV with quotes, commas and line breaks, and read back."""
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    path = f"{checkpoint_dir(spark)}/template-{uuid.uuid4().hex}"
    config = n.select(F.col("n_regionkey").alias("group_pos"), F.col("r_name").alias("group"), F.col("n_nationkey").alias("field_pos"),
                      F.concat(F.lit("^"), "n_name", F.lit('("|,)')).alias("pattern"),
                      F.concat(F.lit('My "nation",\n'), "n_name", F.lit(": {}")).alias("template"))
    config.coalesce(1).write.csv(path, header=True, escape='"')
    return read_template_config(spark, path)


@query("term_array_roundtrip", "SELECT r_regionkey AS pos, r_name AS term FROM region")
def q_term_array_roundtrip(spark, sf):
    """The regions, a few terms, as one JSON array read with their places."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"])
    path = f"{checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    t(spark, sf, "region").agg(F.to_json(names).alias("value")).write.text(path)
    return read_term_list(spark, path).select(F.col("pos").cast("int").alias("pos"), "term")


@query("term_list_roundtrip", """
SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS pos, p_name AS term FROM (SELECT DISTINCT p_name FROM part)
""")
def q_term_list_roundtrip(spark, sf):
    """The distinct part names with their places, one JSON line each (the list grows with the table)."""
    names = category_codes(t(spark, sf, "part"), "p_name")
    path = f"{checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    write_term_lines(names.select(F.col("_code").alias("pos"), F.col("_v").alias("term")), path)
    return read_term_lines(spark, path)


@query("name_map_roundtrip", """
SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS pos, n_name AS name,
       'nation ' || CAST(n_nationkey AS VARCHAR) AS renamed FROM nation
""")
def q_name_map_roundtrip(spark, sf):
    """The nations' names and numbers as one JSON object."""
    pair = F.struct("n_name", F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("v"))
    path = f"{checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    one = t(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("value"))
    one.write.text(path)
    return read_name_map(spark, path)
