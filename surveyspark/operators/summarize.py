"""Per-respondent text: participant summary (T1), field extraction (F1),
sectioned prompt (T2) and prompt/completion pairs (D1, P11)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .broadcast import stored_side
from .codebook import MULTI_SELECT, answers_long, decode_answers, fill_codebook, question_labels, whole_number

# Frame of the participant summary.
SUMMARY_HEAD = "Participant Summary:"
SUMMARY_TAIL = "Answer summary complete."
# Texts treated as "no answer" by field extraction (compared lower-cased).
EMPTY_VALUES = ("keine angabe", "weiß ich nicht", "nan", "")


def respondent_summary(wide: DataFrame, codebook: DataFrame, key: str = "pid",
                       last_label: bool = False) -> DataFrame:
    """``(pid, prompt)``: one multi-line summary per respondent.

    Lines: head; plain questions in column order ``- qid (label): answer``; then
    each multi-select group (chosen options, code 1) ``- qid (label): a, b`` in
    order of first appearance; then each dotted group ``qid (label):`` followed by
    ``  - sub (text): answer``; then the tail. Respondents without answers keep
    head and tail only.

    Plan: unpivot (row-local), broadcast codebook lookups, then ONE aggregation
    by respondent (partial collect per map task); group lines are built from the
    respondent's own array with higher-order functions, so no window and no
    second shuffle. A respondent's rows are bounded by the number of questions.
    """
    dec = decode_answers(answers_long(wide, key), codebook)
    labels = question_labels(fill_codebook(codebook), filled=True)
    main = F.substring_index(F.col("qid"), ".", 1)
    mains = stored_side(labels.select(F.col("qid").alias("main"), F.col("qlabel").alias("mlabel")))
    dec = dec.withColumn("main", main).join(mains, "main", "left")
    is_multi = F.col("qtype") == MULTI_SELECT
    chosen = F.coalesce(whole_number(F.col("value")) == 1, F.lit(False))
    sec = F.when(is_multi, 1).when(F.col("qid").contains("."), 2).otherwise(0)
    sub_label = F.coalesce(F.col("last_label"), F.col("qlabel")) if last_label else F.col("qlabel")
    item = (F.when(is_multi, F.coalesce(F.col("opt_label"), F.col("last_label"), F.col("qlabel")))
             .when(F.col("qid").contains("."),
                   F.concat(F.lit("  - "), F.col("qid"), F.lit(" ("), sub_label, F.lit("): "), F.col("answer")))
             .otherwise(F.concat(F.lit("- "), F.col("qid"), F.lit(" ("), F.col("qlabel"), F.lit("): "),
                                 F.col("answer"))))
    rows = dec.filter(~is_multi | chosen).select(
        "pid", F.struct(sec.alias("sec"), F.col("pos"), F.col("main"),
                        F.coalesce(F.col("mlabel"), F.col("main")).alias("mlabel"), item.alias("item")).alias("r"))
    # every respondent appears once even without answers
    empty = wide.select(F.col(key).alias("pid"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
    grouped = rows.unionByName(empty).groupBy("pid").agg(F.array_sort(F.collect_list("r")).alias("rs"))

    rs = F.col("rs")

    def part(s):
        return F.filter(rs, lambda r: r["sec"] == s)

    def groups(s):
        # distinct group ids in order of first appearance (rs is sorted by (sec, pos))
        return F.array_distinct(F.transform(part(s), lambda r: r["main"]))

    plain_lines = F.transform(part(0), lambda r: r["item"])
    multi_lines = F.transform(groups(1), lambda g: F.concat(
        F.lit("- "), g, F.lit(" ("),
        F.filter(part(1), lambda r: r["main"] == g)[0]["mlabel"], F.lit("): "),
        F.array_join(F.transform(F.filter(part(1), lambda r: r["main"] == g), lambda r: r["item"]), ", ")))
    sub_lines = F.flatten(F.transform(groups(2), lambda g: F.concat(
        F.array(F.concat(g, F.lit(" ("), F.filter(part(2), lambda r: r["main"] == g)[0]["mlabel"], F.lit("):"))),
        F.transform(F.filter(part(2), lambda r: r["main"] == g), lambda r: r["item"]))))
    lines = F.concat(F.array(F.lit(SUMMARY_HEAD)), plain_lines, multi_lines, sub_lines, F.array(F.lit(SUMMARY_TAIL)))
    return grouped.select("pid", F.array_join(lines, "\n").alias("prompt"))


_QUESTION_ID = re.compile(r"(Q[0-9]+(?:\\?[.][0-9]+)*)(.*)", re.S)


def extract_field(text: Column, pattern: str, prefix_match: bool = False) -> Column:
    """First match of ``- {pattern}\\):\\s*(.+)``, stripped; null when empty or one of
    the no-answer values. ``.`` stops at a newline only (as in Python). A question id at the
    front of the pattern means exactly that question; with ``prefix_match`` it is a pattern
    like any other, and ``Q4.1.*`` also meets ``Q4.10``."""
    own = _QUESTION_ID.fullmatch(pattern)
    if own and not prefix_match:
        pattern = own[1].replace("\\.", ".").replace(".", "\\.") + "(?![0-9.])" + own[2].removeprefix(".*")
        pattern += ".*" if own[2].startswith(".*") else ""
    v = strip_ws(F.regexp_extract(text, f"(?d)- {pattern}\\):\\s*(.+)", 1))
    return F.when(~F.lower(v).isin(*EMPTY_VALUES), v)


def extract_fields(df: DataFrame, text: str, fields: Mapping[str, str], prefix_match: bool = False) -> DataFrame:
    """All fields in one projection: ``{output column: pattern}``."""
    return df.withColumns({name: extract_field(F.col(text), pat, prefix_match) for name, pat in fields.items()})


def _sentence(template: str, value: Column) -> Column:
    """The template with the value in its placeholder; a template that one value cannot fill is
    followed by the value."""
    mark = "\0"
    try:
        filled = template.format(mark)
    except (IndexError, KeyError, ValueError, AttributeError):
        filled = f"{template} {mark}"
    first, *rest = filled.split(mark)
    if not rest:
        return F.when(value.isNotNull(), F.lit(filled))
    return F.concat(F.lit(first), *[x for part in rest for x in (value, F.lit(part))])


def sectioned_prompt(df: DataFrame, text: str, config: Sequence[tuple[str, Sequence[tuple[str, str]]]],
                     intro: str, out: str = "prompt", prefix_match: bool = False) -> DataFrame:
    """Intro, then per group with at least one hit ``group:\\n`` + sentences joined by
    ``', '`` + ``'.'``; blocks joined by a blank line.

    ``config`` is ``[(group, [(pattern, template), ...]), ...]`` in order; ``{}`` in a
    template takes the extracted value. One row-local projection.
    """
    tcol = F.col(text)
    sections = []
    for group, fields in config:
        sents = [_sentence(tpl, extract_field(tcol, pat, prefix_match)) for pat, tpl in fields]
        joined = F.concat_ws(", ", *sents)
        any_hit = F.coalesce(*sents).isNotNull()
        sections.append(F.when(any_hit, F.concat(F.lit(group + ":\n"), joined, F.lit("."))))
    return df.withColumn(out, F.concat_ws("\n\n", F.lit(intro), *sections))


def config_from_table(config: DataFrame) -> list[tuple[str, list[tuple[str, str]]]]:
    """Template config table ``(group_pos, group, field_pos, pattern, template)`` as
    the nested list ``sectioned_prompt`` takes (a small configuration collect)."""
    rows = config.orderBy("group_pos", "field_pos").collect()
    out: list[tuple[str, list[tuple[str, str]]]] = []
    for r in rows:
        if not out or out[-1][0] != r["group"]:
            out.append((r["group"], []))
        out[-1][1].append((r["pattern"], r["template"]))
    return out


def prompt_completion_pairs(df: DataFrame, text: str, config, intro: str, completion_pattern: str,
                            keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., prompt, completion)``; rows without a completion are dropped."""
    d = df.withColumn("_completion", extract_field(F.col(text), completion_pattern))
    d = sectioned_prompt(d, text, config, intro, out="_prompt")
    return (d.filter(F.col("_completion").isNotNull())
             .select(*keys, F.col("_prompt").alias("prompt"), F.col("_completion").alias("completion")))
