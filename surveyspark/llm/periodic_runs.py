"""Periodic run detection: string synchronising sets propose periods, exact extension confirms them.

A run is a stretch of consecutive words with smallest period q (words q apart are the same word)
that no neighbouring word extends, of at least ``least_length`` words and ``least_exponent``
periods. All texts of a slice stand in one sequence of word numbers, with a mark of its own in front
of each text and behind the last, so no run crosses a border.

Scale t = 4, 8, 16, ... finds the periods from t to 2t - 1. Every place carries the hash of the t
words from it on. A place belongs to the synchronising set if the smallest hash among the t + 1
places from it on is its own or the last one's; equal contexts of 2t words therefore decide alike.
Two neighbouring places of the set with equal contexts propose their distance as a period. Inside
highly periodic regions (a period of at most t / 4 for t words or more) all hashes repeat and the
set would hold every place, so these places are left out; the periods that they have are found at
smaller scales, the smallest (1 to 3) by comparing words that far apart. A stretch of four periods
p, t <= p < 2t, holds 2t neighbouring places that are not all highly periodic, hence a member of the
set within its first t places and the copy of that member p further on: no run is missed.

Row-local: no shuffle; memory grows with a slice of text (1 MB, or one longer text).

Edge cases: null, empty and blank texts have no words and no runs; rows that repeat an id are
treated one by one; a null id stays null; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import mix, slices

SMALL = 4  # periods below are compared directly
LEAST_LENGTH, LEAST_EXPONENT = 6, 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * _FACTOR + right)


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by]; past the end the last element, whose window holds the closing mark."""
    return np.concatenate([x[by:], np.full(min(by, len(x)), x[-1])])


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i], ..., x[i + width - 1]; ``width`` - 1 is a power of two."""
    reach = 1
    while reach < width - 1:
        x = np.minimum(x, _ahead(x, reach))
        reach *= 2
    return np.minimum(x, _ahead(x, 1))


def _stretches(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _extended(seq: np.ndarray, at: np.ndarray, period: np.ndarray, way: int, step: int) -> np.ndarray:
    """How many places from ``at`` on (``way`` 1: upwards, -1: downwards) hold the word ``period``
    further on. The marks at both ends of ``seq`` stop every comparison."""
    out, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
    reach = np.arange(step)
    while len(open_):
        place = (at[open_] + way * out[open_])[:, None] + way * reach
        same = seq[np.clip(place, 0, len(seq) - 1)] == seq[np.clip(place + period[open_][:, None], 0, len(seq) - 1)]
        whole = same.all(1)
        out[open_] += np.where(whole, step, same.argmin(1))
        open_ = open_[whole]
    return out


def _proposed(hashes: np.ndarray, context: np.ndarray, left_out: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the synchronising set and the distance to the next equal context, t to 2t - 1."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(left_out, most, hashes)
    least = _window_minimum(h, t + 1)
    member = np.flatnonzero((least != most) & ((least == h) | (least == _ahead(h, t))))
    order = np.argsort(context[member], kind="stable")
    ranked, place = context[member][order], member[order]
    gap = np.diff(place)
    ok = (ranked[1:] == ranked[:-1]) & (gap >= t) & (gap < 2 * t)
    return place[:-1][ok], gap[ok]


def _merged(place: np.ndarray, period: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [place, place + reach) of one period that touch, as one."""
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    head = np.append(True, (period[1:] != period[:-1]) | (place[1:] > place[:-1] + reach))[:len(place)]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(place)) - 1
    return place[first], place[last] + reach, period[first]


def runs(words: np.ndarray, first: np.ndarray, least_length: int = LEAST_LENGTH,
         least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted; ``words`` holds the word numbers (not
    negative) of all texts, ``first[d]:first[d + 1]`` those of text d."""
    if least_exponent < 4:
        raise ValueError("the scales find runs of four periods or more")
    n_texts, sizes = len(first) - 1, np.diff(first)
    seq = np.empty(len(words) + n_texts + 1, np.int64)
    marks = first + np.arange(n_texts + 1)  # a mark in front of every text, one behind the last
    inner = np.ones(len(seq), bool)
    inner[marks] = False
    seq[inner], seq[marks] = words, -1 - np.arange(n_texts + 1)
    size_at = np.repeat(np.append(sizes, 0), np.append(sizes + 1, 1))  # words of the text at each place

    found: list[np.ndarray] = []
    for q in range(1, SMALL):
        a, b = _stretches(seq[:-q] == seq[q:]) if len(seq) > q else (np.zeros(0, np.int64),) * 2
        ok = b - a + q >= 4 * q
        found.append(np.stack([a[ok], (b - a + q)[ok], np.full(int(ok.sum()), q)], 1))

    where = np.arange(len(seq))  # places still looked at
    t, now = SMALL, seq
    hashes = mix(seq.astype(np.uint64))
    for by in (1, 2):
        hashes = _joined_hashes(hashes, _ahead(hashes, by))
    while sizes.max(initial=0) >= 4 * t:
        stay = size_at[where] >= 4 * t
        stay[-1] = True
        if stay.mean() < 0.8:
            where, hashes = where[stay], hashes[stay]
            now = seq[where]
        to = np.searchsorted(where, np.arange(len(seq))) if len(where) < len(seq) else np.arange(len(seq))
        border = np.zeros(len(where) + 1, np.int64)
        for start, length, period in (x.T for x in found):
            ok = (4 * period <= t) & (length >= t) & (size_at[start] >= 4 * t)
            begin = to[start[ok]]
            np.add.at(border, begin, 1)
            np.add.at(border, begin + length[ok] - t + 1, -1)
        context = _joined_hashes(hashes, _ahead(hashes, t))
        place, period = _proposed(hashes, context, np.cumsum(border[:-1]) > 0, t)
        if len(place):
            begin, end, period = _merged(place, period, 2 * t)
            begin = begin - _extended(now, begin - 1, period, -1, 2 * t)
            end = end + _extended(now, end, period, 1, 2 * t)
            ok = end - begin + period >= 4 * period
            found.append(np.stack([where[begin[ok]], (end - begin + period)[ok], period[ok]], 1))
        t, hashes = 2 * t, context

    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]  # one stretch: smallest period first
    head = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[:len(rows)]
    rows = rows[head & (rows[:, 1] >= np.maximum(least_length, least_exponent * rows[:, 2]))]
    text = np.searchsorted(marks, rows[:, 0], "right") - 1
    rows = np.column_stack([text, rows[:, 0] - marks[text] - 1, rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeated(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word: does a run hold it behind its first period?"""
    border = np.zeros(int(first[-1]) + 1, np.int64)
    begin = first[found[:, 0]] + found[:, 1]
    np.add.at(border, begin + found[:, 3], 1)
    np.add.at(border, begin + found[:, 2], -1)
    return np.cumsum(border[:-1]) > 0


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Per row ``id_col, n_words, runs`` (start, length, period in words, by start and period) and
    ``collapsed``: the words outside all runs and of each run's first period, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1)):
                part = batch.slice(at, end - at)
                texts = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
                flat = pa.array(chain.from_iterable(texts), pa.binary(), size=int(first[-1]))
                found = runs(flat.dictionary_encode().indices.to_numpy(), first, least_length, least_exponent)
                keep = ~repeated(found, first)
                touched = set(found[:, 0].tolist())
                kept = [b" ".join(compress(w, keep[first[d]:first[d + 1]].tolist()) if d in touched else w)
                        for d, w in enumerate(texts)]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(found[:, 0], np.arange(len(texts) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in (1, 2, 3)],
                                               names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first), pa.int64()), spans, pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def strongest(spans: Column) -> Column:
    """The run with the greatest length over period (ties: smallest start, then period), or null."""
    ranked = F.transform(spans, lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"),
        r["length"].alias("length")))
    best = F.array_max(ranked)
    return F.when(F.size(spans) > 0, F.struct(
        (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of the result of ``collapse_runs``."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        *[c for c in found.columns if c not in ("n_words", "runs", "collapsed")],
        F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.col("collapsed"), "UTF-8"), 256).alias("collapsed_sha256"))
