"""Bindings: chat records, renderings, splits and token budgets
(T5, T6a-c, T7, T8, W5, W6, D2, F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_budget
from ..operators.chat import (CHAT_SYSTEM, chat_dataset, chat_messages, collect_messages, messages_long, render_full,
                              render_pair, render_role_tag, template_error)
from ..operators.split import split_holdout, split_stratified
from .common import SQL_PAIRS, conversation_pairs, t
from .registry import query

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _s(x: str) -> str:
    return STRIP.format(x=x)


def _pairs(spark, sf):
    return conversation_pairs(t(spark, sf, "conversations"))


SYSTEM_DE = CHAT_SYSTEM


@query("chat_messages", f"""WITH {SQL_PAIRS}
SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'system' AS role, '{SYSTEM_DE}' AS content FROM pairs
UNION ALL SELECT conv_id, turn, 1, 'user', text_a FROM pairs
UNION ALL SELECT conv_id, turn, 2, 'assistant', text_b FROM pairs""")
def q_chat_messages(spark, sf):
    m = chat_messages(_pairs(spark, sf), "text_a", "text_b")
    return messages_long(m, ["conv_id", "turn"])


@query("render_header", f"""WITH {SQL_PAIRS}
SELECT conv_id, turn, '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || {_s('text_a')}
       || chr(10) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || {_s('text_b')} || '<|eot_id|>' AS text
FROM pairs""")
def q_render_header(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", render_pair("text_a", "text_b", "header").alias("text"))


@query("render_qa", f"""WITH {SQL_PAIRS}
SELECT conv_id, turn, '### Question:' || chr(10) || {_s('text_a')} || chr(10) || chr(10) || '### Answer:' || chr(10)
       || {_s('text_b')} AS text
FROM pairs""")
def q_render_qa(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", render_pair("text_a", "text_b", "qa").alias("text"))


def _conversations(spark, sf):
    return collect_messages(t(spark, sf, "conversations"), ["conv_id"], order="turn")


@query("render_role_tag", f"""
SELECT conv_id, {_s("string_agg('<|' || role || '|>' || chr(10) || " + _s('text') + " || chr(10), '' ORDER BY turn)")}
       AS text
FROM conversations GROUP BY conv_id""")
def q_render_role_tag(spark, sf):
    return _conversations(spark, sf).select("conv_id", render_role_tag("messages").alias("text"))


SQL_FULL_HEAD = ("'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) {env}"
                 "|| 'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) "
                 "|| chr(10)")


@query("render_full", f"""
WITH f AS (SELECT conv_id, min(turn) AS t0 FROM conversations GROUP BY conv_id),
c AS (SELECT c.*, CASE WHEN c.turn = f.t0 AND c.role = 'system' THEN 1 ELSE 0 END AS is_sys
      FROM conversations c JOIN f USING (conv_id)),
sys AS (SELECT conv_id, {_s('text')} AS sm FROM c WHERE is_sys = 1),
body AS (SELECT conv_id, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
                                    || {_s('text')} || '<|eot_id|>', '' ORDER BY turn) AS b
         FROM c WHERE is_sys = 0 GROUP BY conv_id)
SELECT f.conv_id, {SQL_FULL_HEAD.format(env='')} || coalesce(sys.sm, '') || '<|eot_id|>' || coalesce(body.b, '')
       || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS text
FROM f LEFT JOIN sys USING (conv_id) LEFT JOIN body USING (conv_id)""")
def q_render_full(spark, sf):
    return _conversations(spark, sf).select(
        "conv_id", render_full("messages", add_generation_prompt=True).alias("text"))


# Fixed values for this binding: one tool definition.
TOOLS = [{"type": "function", "function": {"name": "search", "description": "Search the conversation archive",
                                            "parameters": {"type": "object",
                                                           "properties": {"conv_id": {"type": "string"},
                                                                          "turn": {"type": "string"}}}}}]


def tool_conversations(spark, sf):
    """Conversations where the assistant answer at turn 1 becomes a call of the
    ``search`` tool followed by a tool message carrying the original answer."""
    c = t(spark, sf, "conversations")
    call = (F.col("role") == "assistant") & (F.col("turn") == 1)
    calls = F.when(call, F.array(F.struct(
        F.lit("search").alias("name"),
        F.create_map(F.lit("conv_id"), F.col("conv_id").cast("string"),
                     F.lit("turn"), F.col("turn").cast("string")).alias("arguments"))))
    base = c.select("conv_id", (F.col("turn") * 2).alias("o"), "role", "text", calls.alias("tool_calls"))
    tool = c.filter(call).select("conv_id", (F.col("turn") * 2 + 1).alias("o"), F.lit("tool").alias("role"), "text",
                                 F.lit(None).cast(base.schema["tool_calls"].dataType).alias("tool_calls"))
    return collect_messages(base.unionByName(tool), ["conv_id"], order="o", extra=["tool_calls"])


def _tool_json(defs) -> str:
    import json
    return "".join(json.dumps(d, indent=4) + "\n\n" for d in defs).replace("'", "''").replace("\n", "' || chr(10) || '")


@query("render_full_tools", f"""
WITH c0 AS (SELECT conv_id, turn * 2 AS o, turn, role, text,
                   CASE WHEN role = 'assistant' AND turn = 1 THEN 1 ELSE 0 END AS is_call FROM conversations
            UNION ALL SELECT conv_id, turn * 2 + 1, turn, 'tool', text, 0 FROM conversations
            WHERE role = 'assistant' AND turn = 1),
f AS (SELECT conv_id, min(o) AS o0 FROM c0 GROUP BY conv_id),
c1 AS (SELECT c0.*, CASE WHEN c0.o = f.o0 AND c0.role = 'system' THEN 1 ELSE 0 END AS is_sys FROM c0 JOIN f USING (conv_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS rn FROM c1 WHERE is_sys = 0),
sys AS (SELECT conv_id, {_s('text')} AS sm FROM c1 WHERE is_sys = 1),
fu AS (SELECT conv_id, {_s('text')} AS fu FROM r WHERE rn = 1),
body AS (
  SELECT conv_id, string_agg(
    CASE WHEN role IN ('tool', 'ipython') THEN '<|start_header_id|>ipython<|end_header_id|>' || chr(10) || chr(10)
              || CAST(to_json(text) AS VARCHAR) || '<|eot_id|>'
         WHEN is_call = 1 THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
              || '{{"name": "search", "parameters": {{"conv_id": "' || CAST(conv_id AS VARCHAR) || '", "turn": "'
              || CAST(turn AS VARCHAR) || '"}}}}<|eot_id|>'
         ELSE '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_s('text')} || '<|eot_id|>'
    END, '' ORDER BY o) AS b
  FROM r WHERE rn > 1 GROUP BY conv_id)
SELECT f.conv_id,
       {SQL_FULL_HEAD.format(env="|| 'Environment: ipython' || chr(10) ")} || coalesce(sys.sm, '') || '<|eot_id|>'
       || '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)
       || 'Given the following functions, please respond with a JSON for a function call '
       || 'with its proper arguments that best answers the given prompt.' || chr(10) || chr(10)
       || 'Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}.'
       || 'Do not use variables.' || chr(10) || chr(10) || '{_tool_json(TOOLS)}'
       || fu.fu || '<|eot_id|>' || coalesce(body.b, '') AS text, CAST(NULL AS VARCHAR) AS error
FROM f LEFT JOIN sys USING (conv_id) LEFT JOIN fu USING (conv_id) LEFT JOIN body USING (conv_id)""")
def q_render_full_tools(spark, sf):
    m = tool_conversations(spark, sf)
    return m.select("conv_id", render_full("messages", tools=TOOLS).alias("text"),
                    template_error("messages").alias("error"))


@query("render_full_typed_tools", f"""
WITH c0 AS (SELECT conv_id, turn * 2 AS o, turn, role, text,
                   CASE WHEN role = 'assistant' AND turn = 1 THEN 1 ELSE 0 END AS is_call FROM conversations
            UNION ALL SELECT conv_id, turn * 2 + 1, turn, 'tool', text, 0 FROM conversations
            WHERE role = 'assistant' AND turn = 1),
f AS (SELECT conv_id, min(o) AS o0 FROM c0 GROUP BY conv_id),
c1 AS (SELECT c0.*, CASE WHEN c0.o = f.o0 AND c0.role = 'system' THEN 1 ELSE 0 END AS is_sys FROM c0 JOIN f USING (conv_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS rn FROM c1 WHERE is_sys = 0),
sys AS (SELECT conv_id, {_s('text')} AS sm FROM c1 WHERE is_sys = 1),
fu AS (SELECT conv_id, {_s('text')} AS fu FROM r WHERE rn = 1),
body AS (
  SELECT conv_id, string_agg(
    CASE WHEN role IN ('tool', 'ipython') THEN '<|start_header_id|>ipython<|end_header_id|>' || chr(10) || chr(10)
              || CAST(to_json(text) AS VARCHAR) || '<|eot_id|>'
         WHEN is_call = 1 THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
              || '{{"name": "search", "parameters": {{"conv_id": ' || CAST(conv_id AS VARCHAR) || ', "exact": '
              || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "weights": [1, 2.5, ' || CAST(turn AS VARCHAR)
              || '], "filter": {{"role": "user", "text": ' || CAST(to_json(text) AS VARCHAR) || ', "none": null}}}}}}<|eot_id|>'
         ELSE '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_s('text')} || '<|eot_id|>'
    END, '' ORDER BY o) AS b
  FROM r WHERE rn > 1 GROUP BY conv_id)
SELECT f.conv_id,
       {SQL_FULL_HEAD.format(env="|| 'Environment: ipython' || chr(10) ")} || coalesce(sys.sm, '') || '<|eot_id|>'
       || '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)
       || 'Given the following functions, please respond with a JSON for a function call '
       || 'with its proper arguments that best answers the given prompt.' || chr(10) || chr(10)
       || 'Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}.'
       || 'Do not use variables.' || chr(10) || chr(10) || '{_tool_json(TOOLS)}'
       || fu.fu || '<|eot_id|>' || coalesce(body.b, '') AS text, CAST(NULL AS VARCHAR) AS error
FROM f LEFT JOIN sys USING (conv_id) LEFT JOIN fu USING (conv_id) LEFT JOIN body USING (conv_id)""")
def q_render_full_typed_tools(spark, sf):
    """Tool arguments given as JSON text: numbers, a boolean, a list and an object."""
    arguments = "concat('{\\n \"conv_id\" : ', conv_id, ',\"exact\":', conv_id % 2 = 0, ', \"weights\":[1,2.5 , ', t.arguments['turn'], " \
                "'],\"filter\":{\"role\":\"user\", \"text\":', substring(to_json(array(x.content)), 2, length(to_json(array(x.content))) - 2), ',\"none\":null}}')"
    m = tool_conversations(spark, sf).withColumn("messages", F.expr(
        f"transform(messages, x -> struct(x.role, x.content, transform(x.tool_calls, t -> struct(t.name, {arguments} AS arguments)) AS tool_calls))"))
    return m.select("conv_id", render_full("messages", tools=TOOLS, json_arguments=True).alias("text"),
                    template_error("messages").alias("error"))


# Fixed values for this binding: the built-in tools.
BUILTIN = ["search", "code_interpreter"]


@query("render_full_plain_tool_turns", f"""
WITH c0 AS (SELECT conv_id, turn * 2 AS o, role, text FROM conversations
            UNION ALL SELECT conv_id, turn * 2 + 1, 'tool', text FROM conversations WHERE role = 'assistant' AND turn = 1),
f AS (SELECT conv_id, min(o) AS o0 FROM c0 GROUP BY conv_id),
c1 AS (SELECT c0.*, CASE WHEN c0.o = f.o0 AND c0.role = 'system' THEN 1 ELSE 0 END AS is_sys FROM c0 JOIN f USING (conv_id)),
sys AS (SELECT conv_id, {_s('text')} AS sm FROM c1 WHERE is_sys = 1),
body AS (SELECT conv_id, string_agg(
    CASE WHEN role = 'tool' THEN '<|start_header_id|>ipython<|end_header_id|>' || chr(10) || chr(10)
              || CAST(to_json(text) AS VARCHAR) || '<|eot_id|>'
         ELSE '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_s('text')} || '<|eot_id|>'
    END, '' ORDER BY o) AS b FROM c1 WHERE is_sys = 0 GROUP BY conv_id)
SELECT f.conv_id, {SQL_FULL_HEAD.format(env='')} || coalesce(sys.sm, '') || '<|eot_id|>' || coalesce(body.b, '') AS text
FROM f LEFT JOIN sys USING (conv_id) LEFT JOIN body USING (conv_id)""")
def q_render_full_plain_tool_turns(spark, sf):
    """Tool answers are ipython blocks also where no tool list is given."""
    m = tool_conversations(spark, sf)
    plain = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return m.select("conv_id", render_full(plain).alias("text"))


@query("render_full_builtin_tools", f"""
WITH c0 AS (SELECT conv_id, turn * 2 AS o, turn, role, text,
                   CASE WHEN role = 'assistant' AND turn = 1 THEN 1 ELSE 0 END AS is_call FROM conversations
            UNION ALL SELECT conv_id, turn * 2 + 1, turn, 'tool', text, 0 FROM conversations
            WHERE role = 'assistant' AND turn = 1),
f AS (SELECT conv_id, min(o) AS o0 FROM c0 GROUP BY conv_id),
c1 AS (SELECT c0.*, CASE WHEN c0.o = f.o0 AND c0.role = 'system' THEN 1 ELSE 0 END AS is_sys FROM c0 JOIN f USING (conv_id)),
sys AS (SELECT conv_id, {_s('text')} AS sm FROM c1 WHERE is_sys = 1),
body AS (SELECT conv_id, string_agg(
    CASE WHEN role = 'tool' THEN '<|start_header_id|>ipython<|end_header_id|>' || chr(10) || chr(10)
              || CAST(to_json(text) AS VARCHAR) || '<|eot_id|>'
         WHEN is_call = 1 THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
              || '<|python_tag|>search.call(conv_id="' || CAST(conv_id AS VARCHAR) || '", turn="' || CAST(turn AS VARCHAR)
              || '")<|eom_id|>'
         ELSE '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_s('text')} || '<|eot_id|>'
    END, '' ORDER BY o) AS b FROM c1 WHERE is_sys = 0 GROUP BY conv_id)
SELECT f.conv_id,
       {SQL_FULL_HEAD.format(env="|| 'Environment: ipython' || chr(10) || 'Tools: search' || chr(10) || chr(10) ")}
       || 'You have access to the following functions. To call a function, please respond with JSON for a function call.'
       || 'Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}.'
       || 'Do not use variables.' || chr(10) || chr(10) || '{_tool_json(TOOLS)}'
       || coalesce(sys.sm, '') || '<|eot_id|>' || coalesce(body.b, '') AS text, CAST(NULL AS VARCHAR) AS error
FROM f LEFT JOIN sys USING (conv_id) LEFT JOIN body USING (conv_id)""")
def q_render_full_builtin_tools(spark, sf):
    """Built-in tools called behind the python tag, other tools listed in the system block."""
    m = tool_conversations(spark, sf)
    return m.select("conv_id", render_full("messages", tools=TOOLS, builtin_tools=BUILTIN, tools_in_user_message=False)
                    .alias("text"), template_error("messages", tools_listed=False).alias("error"))


# --- splits -----------------------------------------------------------------------------

def _keyed_pairs(spark, sf):
    return _pairs(spark, sf).withColumn("pair_key", F.concat_ws("-", "conv_id", "turn"))


@query("split_holdout", f"""WITH {SQL_PAIRS},
p AS (SELECT conv_id, turn, CASE WHEN conv_id % 29 <> 0 THEN CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END
             AS pair_key FROM pairs),
k AS (SELECT *, coalesce(md5('42|' || pair_key), '') AS h FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY h, pair_key) AS rn, count(*) OVER () AS n FROM k)
SELECT conv_id, turn, CASE WHEN rn <= floor(0.9 * n) THEN 'train' ELSE 'validation' END AS split FROM r""")
def q_split_holdout(spark, sf):
    """Rows without a key stay in the split (they come first)."""
    keyed = _keyed_pairs(spark, sf).withColumn("pair_key", F.when(F.col("conv_id") % 29 != 0, F.col("pair_key")))
    return split_holdout(keyed, "pair_key", 0.9, 42).select("conv_id", "turn", "split")


@query("split_stratified", """
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN quality END AS quality FROM labels),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)),
             doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM l)
SELECT doc_id, quality, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'validation' END AS split FROM r""")
def q_split_stratified(spark, sf):
    """Rows without a label are a stratum of their own."""
    lab = t(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("quality")).alias("quality"))
    return split_stratified(lab, "doc_id", "quality", 0.8, 42)


@query("split_sizes", f"""WITH {SQL_PAIRS},
n AS (SELECT count(*) AS n FROM pairs)
SELECT 'train' AS split, CAST(floor(0.9 * n) AS BIGINT) AS n_rows FROM n
UNION ALL SELECT 'validation', CAST(n - floor(0.9 * n) AS BIGINT) FROM n""")
def q_split_sizes(spark, sf):
    d = split_holdout(_keyed_pairs(spark, sf), "pair_key", 0.9, 42)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("chat_dataset", f"""WITH {SQL_PAIRS},
k AS (SELECT conv_id, turn, text_a, text_b, md5('7|' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)) AS h,
             CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS pair_key FROM pairs),
r AS (SELECT *, row_number() OVER (ORDER BY h, pair_key) AS rn, count(*) OVER () AS n FROM k)
SELECT conv_id, turn, CASE WHEN rn <= floor(0.9 * n) THEN 'train' ELSE 'validation' END AS split,
       '{SYSTEM_DE}' AS system_content, text_a AS user_content, text_b AS assistant_content FROM r""")
def q_chat_dataset(spark, sf):
    d = chat_dataset(_keyed_pairs(spark, sf), "pair_key", "text_a", "text_b", 0.9, 7)
    return d.select("conv_id", "turn", "split", F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"),
                    F.col("messages")[2]["content"].alias("assistant_content"))


# --- F13 ---------------------------------------------------------------------------------

@query("token_budget", rf"""
WITH d AS (SELECT doc_id, {_s('text')} AS s FROM documents),
tk AS (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE string_split_regex(s, '\s+') END AS toks FROM d)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(greatest(2048 - len(toks), 0) AS BIGINT) AS n_pad,
       len(toks) > 2048 AS truncated, CAST(length(array_to_string(toks[1:2048], ' ')) AS BIGINT) AS kept_chars
FROM tk""")
def q_token_budget(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", token_budget("text", 2048).alias("b"))
    return d.select("doc_id", "b.n_tokens", "b.n_pad", "b.truncated",
                    F.length("b.kept_text").cast("bigint").alias("kept_chars"))
