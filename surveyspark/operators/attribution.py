"""Feature attribution tables: linear attribution (M4b), top features (W3),
attribution sentences (T3), nested JSON in and out (S7, K5, F10).

Two forms are used:
  long   (class_label, example_index, feature_pos, feature, value)
  nested (class_label, example_index, attrs array<struct<feature_pos, feature, value>>)
Row-local steps work on the nested form so the explanation chain needs no shuffle;
``nest_attribution`` converts long -> nested with one aggregation by example.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import format_fixed
from ..sources.records import JSON_OPENS, JSON_STAYS, JSON_STRING, read_records
from .broadcast import stored
from .codebook import forward_fill, running_sums

# Frame of the attribution sentence.
TEXT_HEAD = "The most important features are: "


def linear_attribution(df: DataFrame, key: str, features: Sequence[str],
                       weights: Mapping[str, Mapping[str, float]], nested: bool = False) -> DataFrame:
    """Exact attribution of a linear score per class: ``phi_j = w_j * (x_j - mean x_j)``.

    The feature means are one global aggregate (a one-row statistic read back as
    literals); everything else is row-local: every input row yields one record per
    class, no shuffle.
    """
    feats = list(features)
    means = df.agg(*[F.avg(F.col(f)).alias(f) for f in feats]).first()
    per_class = []
    for cls, w in weights.items():
        attrs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("feature_pos"), F.lit(f).alias("feature"),
                                   (F.lit(float(w.get(f, 0.0))) * (F.col(f) - F.lit(float(means[f] or 0.0))))
                                   .cast("double").alias("value"))
                          for i, f in enumerate(feats)])
        per_class.append(F.struct(F.lit(str(cls)).alias("class_label"), attrs.alias("attrs")))
    out = df.select(F.col(key).cast("bigint").alias("example_index"), F.inline(F.array(*per_class)))
    out = out.select("class_label", "example_index", "attrs")
    return out if nested else explode_attrs(out)


def explode_attrs(nested: DataFrame, attrs: str = "attrs") -> DataFrame:
    """nested -> long (row-local)."""
    keep = [c for c in nested.columns if c != attrs]
    return nested.select(*keep, F.inline(F.col(attrs)))


def nest_attribution(long: DataFrame, keys: Sequence[str] = ("class_label", "example_index")) -> DataFrame:
    """long -> nested: one aggregation by example (partial collect per map task);
    an example holds one entry per feature, so no group grows with the data."""
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col("feature_pos").cast("bigint").alias("feature_pos"), "feature",
                 F.col("value").cast("double").alias("value")))).alias("attrs"))


def sort_by_magnitude(attrs: Column) -> Column:
    """Entries by |value| descending; ties keep feature order (stable)."""
    keyed = F.transform(attrs, lambda a: F.struct(
        (-F.abs(a["value"])).alias("k"), a["feature_pos"].alias("p"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda x: x["a"])


def top_n(attrs: Column, n: int = 10) -> Column:
    return F.slice(sort_by_magnitude(attrs), 1, n)


def readable(feature: Column) -> Column:
    return F.translate(feature, "_", " ")


def top_features(attribution: DataFrame, n: int = 10) -> DataFrame:
    """``(class_label, example_index, rank, feature, value)`` of the ``n`` largest
    |value| per example, feature names with ``_`` shown as blanks. The nested form (``attrs``)
    is cut row by row, without a shuffle; the long form is nested first."""
    nested = attribution if "attrs" in attribution.columns else nest_attribution(attribution)
    top = nested.select("class_label", "example_index", F.posexplode(top_n(F.col("attrs"), n)).alias("rank", "a"))
    return top.select("class_label", "example_index", (F.col("rank") + 1).cast("bigint").alias("rank"),
                      readable(F.col("a.feature")).alias("feature"), F.col("a.value").alias("value"))


def attribution_sentence(attrs: Column, n: int = 10) -> Column:
    """``The most important features are: "f" with 0.12 (positive), ... .``"""
    parts = F.transform(top_n(attrs, n), lambda a: F.concat(
        F.lit('"'), readable(a["feature"]), F.lit('" with '), format_fixed(a["value"], 2),
        F.lit(" ("), F.when(a["value"] > 0, F.lit("positive")).otherwise(F.lit("negative")), F.lit(")")))
    return F.concat(F.lit(TEXT_HEAD), F.array_join(parts, ", "), F.lit("."))


def attribution_text(nested: DataFrame, n: int = 10, attrs: str = "attrs", out: str = "shap_text") -> DataFrame:
    return nested.withColumn(out, attribution_sentence(F.col(attrs), n))


def to_json_lines(nested: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Nested attribution as JSON lines ``{"class": {"index": {"feature": value}}}``,
    one line per example, so no single document gathers the whole table."""
    inner = F.map_from_entries(F.transform(F.array_sort(F.col(attrs)),
                                           lambda a: F.struct(a["feature"], a["value"])))
    doc = F.create_map(F.col("class_label"), F.create_map(F.col("example_index").cast("string"), inner))
    return nested.select(F.to_json(doc).alias("json"))


def explode_attribution_json(df: DataFrame, col: str = "json") -> DataFrame:
    """Nested attribution JSON (class -> index -> feature -> value) to the long form.
    Index keys become integers; feature order within an example is kept."""
    m = F.from_json(F.col(col), "map<string,map<string,map<string,double>>>")
    lvl1 = df.select(F.explode(m).alias("class_label", "_ex"))
    lvl2 = lvl1.select("class_label", F.explode("_ex").alias("_idx", "_feats"))
    lvl3 = lvl2.select("class_label", F.col("_idx").cast("bigint").alias("example_index"),
                       F.posexplode("_feats").alias("feature_pos", "feature", "value"))
    return lvl3.select("class_label", "example_index", F.col("feature_pos").cast("bigint").alias("feature_pos"),
                       "feature", "value")


def document_lines(nested: DataFrame, attrs: str = "attrs") -> DataFrame:
    """The whole attribution as one JSON document (class -> index -> feature -> value) in text lines
    ``(class_rank, example_index, line)``, one per example and a last one; written in this order they
    are the document. Classes are few; no line holds more than one example."""
    inner = F.map_from_entries(F.transform(F.array_sort(F.col(attrs)), lambda a: F.struct(a["feature"], a["value"])))
    quoted = lambda c: F.regexp_extract(F.to_json(F.create_map(c.cast("string"), F.lit(0))), r"(?s)\A\{(.*):0\}\z", 1)
    first = nested.groupBy("class_label").agg(F.min("example_index").alias("_first"))
    first = first.withColumn("class_rank", F.row_number().over(Window.orderBy("class_label")).cast("bigint"))
    d = nested.join(F.broadcast(first), "class_label")  # a row per class of the model
    begins = F.col("example_index") == F.col("_first")
    head = F.when(begins, F.concat(F.when(F.col("class_rank") == 1, "{").otherwise("}, "), quoted(F.col("class_label")), F.lit(": {"))
                  ).otherwise(F.lit(", "))
    lines = d.select("class_rank", "example_index", F.concat(
        head, quoted(F.col("example_index")), F.lit(": "), F.to_json(inner)).alias("line"))
    end = first.agg(F.max("class_rank").alias("n")).select(
        (F.coalesce("n", F.lit(0)) + 1).alias("class_rank"), F.lit(0).cast("bigint").alias("example_index"),
        F.when(F.col("n").isNull(), "{}").otherwise("}}").alias("line"))
    return lines.unionByName(end)


DOCUMENT_CHUNK = 4096  # objects of a document whose depth is summed up in one task


def read_attribution_document(spark: SparkSession, path: str, chunk: int = DOCUMENT_CHUNK) -> DataFrame:
    """One nested JSON document per file (class -> index -> feature -> value), of any size and with any
    line breaks, to the long form ``(file, class_label, example_index, feature_pos, feature, value)``.

    The text is cut behind every closing brace outside strings, by many tasks per file
    (``sources/records.py``). The depth in front of a piece is the sum of the braces opened less the
    pieces before it, the class the last key that opened the second level; both are two-level scans over
    chunks of pieces. A piece that closes the third level is an example and is parsed by itself. Objects
    without members give no rows; members that are no numbers are missing."""
    d = read_records(spark, path, "}", JSON_OPENS, JSON_STAYS)
    key = rf"({JSON_STRING})\s*+:\s*+\{{"
    other = rf'(?:[^"]++|{JSON_STRING}(?!\s*+:\s*+\{{))*+'
    d = d.withColumn("_keys", F.regexp_extract_all("text", F.lit(rf"(?s)\G{other}{key}"), F.lit(1)))
    bare = F.regexp_replace("text", rf"(?s){JSON_STRING}|[^\"{{]++", "")
    d = d.withColumn("_opens", F.length(bare).cast("bigint"))
    d, _ = stored(d.select("file", "record_no", "text", "_keys", "_opens"))  # read by both scans, for their chunks and for their rows
    at = F.floor(F.col("record_no") / F.lit(chunk))
    d = running_sums(d, {"_depth": F.col("_opens") - 1}, ["record_no"], ["file"], bucket=at)
    before = F.col("_depth") - F.col("_opens") + 1
    d = d.withColumn("_class", F.when((before < 2) & (before + F.col("_opens") >= 2), F.try_element_at("_keys", F.lit(1))))
    d = forward_fill(d, ["_class"], ["record_no"], ["file"], bucket=at)
    said = lambda c: F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]
    body = F.regexp_extract("text", rf"(?s)\A(?:{other}{key})*+(.*)\z", 2)
    m = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,double>")
    example = d.filter((F.col("_depth") == 2) & (F.col("_opens") > 0)).select(
        "file", said(F.col("_class")).alias("class_label"),
        said(F.element_at("_keys", -1)).cast("bigint").alias("example_index"), F.posexplode(m).alias("feature_pos", "feature", "value"))
    return example.withColumn("feature_pos", F.col("feature_pos").cast("bigint"))


def parse_attribution_text(c, value_type: str = "double") -> Column:
    """Dict text (JSON or Python-literal style with single quotes) -> ``map<string, value_type>``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(col, f"map<string,{value_type}>", {"allowSingleQuotes": "true"})
