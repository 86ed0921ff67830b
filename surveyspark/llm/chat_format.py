"""Chat formatting of typed content parts, with DataFrame functions only.

A message is a list of parts (text, image, audio, document). A visitor over the parts writes
escaped text, or an ordered placeholder ``<|kind:number|>`` whose number counts the attachments
of the conversation, and records the attachment's reference and its expanded token count.

Template: ``<s>role`` line feed ``text</s>`` per turn. Control strings inside roles and texts
get a backslash behind their first character and backslashes are doubled, so nothing in a text
can be read as a mark and every text can be read back. The loss mask holds the spans of the
assistant's texts (code points, end exclusive).

Edge cases: null or missing text or parts count as empty text, a null role as the empty role;
a part of an unknown kind becomes a placeholder ``other`` of 0 tokens; rows of one turn number
are ordered by role, then text; a null conversation id is a conversation of its own; an empty
table gives an empty result; other columns are ignored. A conversation's text is one value, so
its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
# Control strings that a text must not smuggle in: first character, then the rest.
_HEAD, _TAIL = r"(<|\[)", r"(/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>|\|)"
_BREAK = r"<\br>"  # a line feed inside a role

#: Expanded tokens of one unit of an attachment: a tile, a second, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _HEAD + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _HEAD + r"\\" + _TAIL, "$1$2"), r"\\\\", r"\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(_BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_BREAK), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """Parts of a message that is plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            none.cast("string").alias("ref"), none.cast("bigint").alias("units"))).cast(PARTS)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin(*TOKENS_PER_UNIT), part["kind"]).otherwise(F.lit("other"))


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        rate = F.when(part["kind"] == kind, F.lit(n)).otherwise(rate)
    return (rate * F.coalesce(part["units"], F.lit(1))).cast("bigint")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """Per conversation: ``conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens``."""
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(parts_col), F.expr(f"cast(array() as {PARTS})")).alias("parts"))
    in_turns = Window.partitionBy("conv_id").orderBy("turn", "role", F.col("parts").cast("string"))
    before = in_turns.rowsBetween(Window.unboundedPreceding, -1)
    attached = F.filter("parts", lambda p: ~_is_text(p))
    m = (m.withColumn("ordinal", F.row_number().over(in_turns))
         .withColumn("seen", F.coalesce(F.sum(F.size(attached)).over(before), F.lit(0))))
    number = lambda i: F.col("seen") + F.size(F.filter(F.slice("parts", 1, i + 1), lambda p: ~_is_text(p)))
    visited = F.transform("parts", lambda p, i: F.when(_is_text(p), escape(p["text"])).otherwise(
        F.concat(F.lit("<|"), _kind(p), F.lit(":"), number(i).cast("string"), F.lit("|>"))))
    recorded = F.transform(F.filter("parts", lambda p: ~_is_text(p)), lambda p, i: F.struct(
        (F.col("seen") + i + 1).alias("number"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    m = (m.withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
         .withColumn("body", F.array_join(visited, "")).withColumn("attached", recorded)
         .withColumn("size", F.length("head") + F.length("body") + len(CLOSE)))
    m = m.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("ordinal", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "at",
                    (F.col("at") + F.length("body")).alias("end"), (F.col("role") == loss_role).alias("loss"), "attached")
    chats = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(
            t["at"].cast("bigint").alias("start"), t["end"].cast("bigint").alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, unescaped (placeholders stay)."""
    pieces = F.split(formatted, CLOSE)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(turns, lambda p: F.struct(
        unescape_role(F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, "\n") - F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + F.lit(1))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """Everything under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted conversations."""
    c = (chats.withColumn("back", read_back(F.col("formatted")))
         .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans"))))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"))
