"""Chat-format training text: chat records (T5), pair renderings (T6a, T6b),
role-tag rendering (T6c), the full chat template without and with tools (T7, T8)
and the chat dataset with its split (D2)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .split import split_holdout

# System message of the classification chat records.
CHAT_SYSTEM = ("Du bist ein hilfreicher Assistent, der klassifiziert, ob eine Person ihre "
               "Krankenversicherung wechseln wird oder nicht.")
# Special strings of the chat templates.
BOS = "<|begin_of_text|>"
EOT = "<|eot_id|>"
HDR_START, HDR_END = "<|start_header_id|>", "<|end_header_id|>"
CUTOFF_LINE = "Cutting Knowledge Date: December 2023\n"
DEFAULT_DATE = "26 Jul 2024"
TOOLS_INTRO = ("Given the following functions, please respond with a JSON for a function call "
               "with its proper arguments that best answers the given prompt.\n\n"
               'Respond in the format {"name": function name, "parameters": dictionary of argument name '
               'and its value}.Do not use variables.\n\n')
TOOLS_SYSTEM = ("You have access to the following functions. To call a function, please respond with JSON for a "
                'function call.Respond in the format {"name": function name, "parameters": dictionary of argument name '
                'and its value}.Do not use variables.\n\n')
EOM, PYTHON_TAG, CODE_TOOL = "<|eom_id|>", "<|python_tag|>", "code_interpreter"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chat_messages(df: DataFrame, prompt: str = "prompt", completion: str = "completion",
                  system: str = CHAT_SYSTEM, out: str = "messages") -> DataFrame:
    """``messages``: system, user (prompt), assistant (completion)."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")),
        F.struct(F.lit("assistant").alias("role"), _c(completion).alias("content")))
    return df.withColumn(out, msgs)


def messages_long(df: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    """``(keys..., pos, role, content)``, one row per message (row-local)."""
    return df.select(*keys, F.posexplode(messages).alias("pos", "m")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


def render_pair(prompt, completion, style: str = "header") -> Column:
    """One prompt/completion pair as training text (both sides stripped).

    ``header``: header tags with a single newline, no end tag after the user part;
    ``qa``: ``### Question:`` / ``### Answer:`` blocks."""
    p, c = strip_ws(_c(prompt)), strip_ws(_c(completion))
    if style == "header":
        return F.concat(F.lit(f"{BOS}{HDR_START}user{HDR_END}\n"), p,
                        F.lit(f"\n{HDR_START}assistant{HDR_END}\n"), c, F.lit(EOT))
    if style == "qa":
        return F.concat(F.lit("### Question:\n"), p, F.lit("\n\n### Answer:\n"), c)
    raise ValueError(style)


def collect_messages(long: DataFrame, keys: Sequence[str], order: str = "turn", role: str = "role",
                     content: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """Long turns -> ordered ``messages`` per conversation (one aggregation by
    conversation; the output row holds the whole conversation by definition)."""
    st = F.struct(F.col(order).alias("_o"), F.col(role).alias("role"), F.col(content).alias("content"),
                  *[F.col(e) for e in extra])
    by_order = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)
    g = long.groupBy(*keys).agg(F.array_sort(F.collect_list(st), by_order).alias("_m"))
    fields = ["role", "content", *extra]
    return g.select(*keys, F.transform("_m", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("messages"))


def render_role_tag(messages) -> Column:
    """``<|role|>\\ncontent\\n`` per message (content stripped), whole text stripped."""
    parts = F.transform(_c(messages), lambda m: F.concat(
        F.lit("<|"), m["role"], F.lit("|>\n"), strip_ws(m["content"]), F.lit("\n")))
    return strip_ws(F.array_join(parts, ""))


def _json_string(s: Column) -> Column:
    """A string as a JSON string literal (quotes and escapes, non-ASCII kept)."""
    j = F.to_json(F.array(s))
    return F.substring(j, 2, F.length(j) - 2)


def _json_object(m: Column) -> Column:
    """``map<string,string>`` as JSON text with ``", "`` and ``": "`` separators."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        _json_string(e["key"]), F.lit(": "), _json_string(e["value"]))), ", "), F.lit("}"))


_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'


def json_text(c: Column) -> Column:
    """JSON text of any value with ``", "`` and ``": "`` separators, no other space outside strings, and
    strings with the escapes they need (non-ASCII kept); numbers as written."""
    parts = F.regexp_extract_all(c, F.lit(rf'(?s){_JSON_STRING}|[^"]++'), F.lit(0))
    said = lambda x: _json_string(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])
    spaced = lambda x: F.replace(F.replace(F.regexp_replace(x, r"\s+", ""), F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith('"'), said(x)).otherwise(spaced(x))), "")


def render_full(messages, add_generation_prompt: bool = False, date_string: str = DEFAULT_DATE,
                tools: Sequence[dict] | None = None, builtin_tools: Sequence[str] | None = None,
                tools_in_user_message: bool = True, calls: bool | None = None, json_arguments: bool = False) -> Column:
    """The full chat template.

    A leading system message is pulled into the system header. ``tools`` are listed in front of
    the first remaining message, or in the system header when ``tools_in_user_message`` is
    false; ``builtin_tools`` are named in the header and called behind the python tag, and then
    calls end with the message tag. ``tool``/``ipython`` messages render as ipython blocks with
    their content as a JSON string, an assistant message with one entry in ``tool_calls``
    (``array<struct<name, arguments map<string,string>>>``, or with ``json_arguments`` arguments as the
    text of a JSON object of any values; ``calls`` says whether the messages have that field, by
    default when tools are given) as a call. A conversation the template
    cannot render yields null; ``template_error`` says why.
    """
    msgs = _c(messages)
    calls = bool(tools or builtin_tools) if calls is None else calls
    listed = bool(tools) and tools_in_user_message
    first = F.get(msgs, F.lit(0))
    has_sys = F.coalesce(first["role"] == "system", F.lit(False))
    system_message = F.when(has_sys, _text(first)).otherwise(F.lit(""))
    rest = F.when(has_sys, F.slice(msgs, 2, 1 << 30)).otherwise(msgs)
    head = BOS + f"{HDR_START}system{HDR_END}\n\n"
    if tools or builtin_tools is not None:
        head += "Environment: ipython\n"
    if builtin_tools is not None:
        head += "Tools: " + ", ".join(x for x in builtin_tools if x != CODE_TOOL) + "\n\n"
    head += CUTOFF_LINE + f"Today Date: {date_string}\n\n"
    tool_text = "".join(json.dumps(t, indent=4, ensure_ascii=False) + "\n\n" for t in tools or ())
    if tools and not tools_in_user_message:
        head += TOOLS_SYSTEM + tool_text
    out = [F.lit(head), system_message, F.lit(EOT)]
    if listed:
        out += [F.lit(f"{HDR_START}user{HDR_END}\n\n" + TOOLS_INTRO + tool_text), _text(F.get(rest, F.lit(0))), F.lit(EOT)]
        rest = F.slice(rest, 2, 1 << 30)
    end = F.lit(EOT if builtin_tools is None else EOM)

    def one(m):
        block = F.concat(F.lit(HDR_START), m["role"], F.lit(HDR_END + "\n\n"), _text(m), F.lit(EOT))
        answer = F.concat(F.lit(f"{HDR_START}ipython{HDR_END}\n\n"),
                          _json_string(F.coalesce(m["content"], F.lit(""))), F.lit(EOT))
        plain = F.when(m["role"].isin("tool", "ipython"), answer).otherwise(block)
        if not calls:
            return plain
        call = F.get(m["tool_calls"], F.lit(0))
        given = json_text(call["arguments"]) if json_arguments else _json_object(call["arguments"])
        said = F.concat(F.lit('{"name": "'), call["name"], F.lit('", "parameters": '), given, F.lit("}"))
        if builtin_tools:
            named = F.from_json(call["arguments"], "map<string,string>") if json_arguments else call["arguments"]
            arguments = F.array_join(F.transform(F.map_entries(named), lambda e: F.concat(
                e["key"], F.lit('="'), e["value"], F.lit('"'))), ", ")
            said = F.when(call["name"].isin(*builtin_tools), F.concat(
                F.lit(PYTHON_TAG), call["name"], F.lit(".call("), arguments, F.lit(")"))).otherwise(said)
        return F.when(m["tool_calls"].isNull(), plain).otherwise(
            F.concat(F.lit(f"{HDR_START}assistant{HDR_END}\n\n"), said, end))
    out.append(F.array_join(F.transform(rest, one), ""))
    if add_generation_prompt:
        out.append(F.lit(f"{HDR_START}assistant{HDR_END}\n\n"))
    return F.when(template_error(messages, listed, calls).isNull(), F.concat(*out))


def _text(message: Column) -> Column:
    return F.coalesce(strip_ws(message["content"]), F.lit(""))


def template_error(messages, tools_listed: bool = True, calls: bool = True) -> Column:
    """Error text for conversations the template cannot render, else null."""
    msgs = _c(messages)
    n = F.coalesce(F.size(msgs), F.lit(0))
    lead = F.when(F.get(msgs, F.lit(0))["role"] == "system", 1).otherwise(0)
    error = F.when(n < 1, F.lit("The conversation has no messages."))
    if tools_listed:
        error = error.when(n - lead < 1, F.lit("Cannot put tools in the first user message when there's no first user message!"))
    if calls:
        many = F.exists(msgs, lambda m: F.coalesce(m["tool_calls"].isNotNull() & (F.size(m["tool_calls"]) != 1), F.lit(False)))
        error = error.when(many, F.lit("This model only supports single tool-calls at once!"))
    return error


def chat_dataset(df: DataFrame, key: str, prompt: str = "prompt", completion: str = "completion",
                 frac: float = 0.9, seed: int = 42) -> DataFrame:
    """Chat records with a reproducible train/validation split (column ``split``)."""
    return split_holdout(chat_messages(df, prompt, completion), key, frac, seed)
