"""Similarity join on word shingles with adaptive multi-match prefixes.

Documents are sets of distinct 5-word shingles, ordered rarest first by a corpus-wide estimate
(any fixed order is exact). Two sets of sizes n >= m with Jaccard >= t share at least
``a = ceil(t (n + m) / (1 + t))`` shingles; the k-th shared one stands before place
``n - a + k`` of the larger and ``m - a + k`` of the smaller set. So a document may keep a
prefix that is l - 1 shingles longer and then needs l shared prefix shingles before it is
verified. Every document picks its own l from the estimated number of candidates its prefix
meets; a pair needs min(l, l') matches.

Steps: (1) counts of shingles in hashed cells (a fixed 2^17, summed over all documents) give
order and cost; (2) every block asks which of its prefix shingles occur elsewhere (``blocks``),
only those become rows; (3) equal sets fall into one class; (4) a first round verifies every
document against one central document that it meets, and merges what links, so a large group
of near copies is a star and not all its pairs; (5) the multi-match
join verifies what is left between different components, after a bound from one parity bit per
hashed place of a set; (6) components of all links.

Edge cases: null or wordless text: the empty set, linked with nothing, its own component; fewer
than five words: the whole sequence is the one shingle; very long texts are whole sets;
repeated rows are one class, rows that repeat an id with another text are documents of their own
(each linked by its own text, both under the one id); a null doc_id links with nothing and has a null component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import blocks
from surveyspark.llm.components import components
from surveyspark.llm.words import Family, Words, has_window, mix, owner, returning, slices, window_hashes

WORDS = 5
CELLS = 1 << 17  # cells of the frequency estimate: 1 MB, whatever the corpus
MOST_MATCHES = 8  # most shared prefix shingles that are asked for
VERIFY_COST = 16  # one verification (two texts sent) against one shared prefix entry
PARITY_BITS = 512  # a bit per hashed place: is the number of shingles there odd?

_FAMILY = Family(21, lower=True)


class Sets:
    """Distinct shingles of every text of a slice: ``shingle[first[d]:first[d + 1]]``, ascending."""

    def __init__(self, col: pa.Array, width: int):
        words = Words(col)
        h = words.hashes(_FAMILY)
        text = owner(words)
        full = has_window(words, width)
        hashes, texts = [window_hashes(h, width, _FAMILY)[full]], [text[full]]
        for size in range(1, width):  # texts with fewer words: the whole sequence
            at = words.first[:-1][words.count == size]
            if len(at):
                with np.errstate(over="ignore"):
                    total = np.full(len(at), _FAMILY.factor[40 + size])
                    for k in range(size):
                        total += h[at + k] * _FAMILY.factor[k]
                hashes.append(mix(total))
                texts.append(text[at])
        hashes, texts = np.concatenate(hashes), np.concatenate(texts)
        order = np.lexsort((hashes, texts))
        hashes, texts = hashes[order], texts[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])) if len(hashes) else np.zeros(0, bool)
        self.shingle, self.text = hashes[new], texts[new]
        self.first = np.searchsorted(self.text, np.arange(len(col) + 1))
        self.size = np.diff(self.first)


def _cell(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - 17)).astype(np.int64)


def cell_counts(docs: DataFrame, width: int = WORDS) -> np.ndarray:
    """Shingles of the whole corpus per hashed cell; each task sends at most CELLS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            col = batch.column(0)
            for a, b in slices(col):
                total += np.bincount(_cell(Sets(col.slice(a, b - a), width).shingle), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(returning(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, np.int64)
    out[np.asarray(found.column("cell"))] = np.asarray(found.column("n"))
    return out


class Prefixes:
    """Rarest-first prefixes of a slice's sets, each with the number of matches it asks for."""

    def __init__(self, sets: Sets, counts: np.ndarray, t_num: int, t_den: int):
        n = sets.size
        cell = _cell(sets.shingle)
        order = np.lexsort((sets.shingle, counts[cell], sets.text))
        self.shingle = sets.shingle[order]
        self.place = np.arange(len(order)) - np.repeat(sets.first[:-1], n)
        # what a cell holds beyond the usual is what its frequent shingles add
        extra = np.maximum(counts[cell[order]] - int(np.median(counts)), 0)
        upto = np.concatenate([[0], np.cumsum(extra)])
        least = -(-t_num * n // t_den)  # smallest partner
        shared = -(-t_num * (n + least) // (t_num + t_den))
        base = np.where(n > 0, n - shared + 1, 0)
        # most candidates are about as large as the set itself, and those it meets in this prefix
        usual = np.where(n > 0, n - (-(-2 * t_num * n // (t_num + t_den))) + 1, 0)
        costs = []
        for l in range(1, MOST_MATCHES + 1):
            met = upto[sets.first[:-1] + np.minimum(usual + l - 1, n)] - upto[sets.first[:-1]]
            costs.append(met * (1 + VERIFY_COST / l))
        # no more matches than the fewest shingles that a partner shares
        self.matches = np.minimum(np.argmin(np.stack(costs), axis=0) + 1, np.maximum(shared, 1))
        length = np.minimum(base + self.matches - 1, n)
        self.inside = self.place < np.repeat(length, n)


def prefixes(docs: DataFrame, width: int, t_num: int, t_den: int) -> DataFrame:
    """Per document: ``id, said`` (hash of its text), ``n, sig_a, sig_b, matches, parity`` and its packed
    ``prefix``, rarest first."""
    counts = cell_counts(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = Sets(batch.column(1).slice(a, b - a), width)
                prefix = Prefixes(sets, counts, t_num, t_den)
                sig = []
                for k in range(2):
                    with np.errstate(over="ignore"):
                        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.shingle + _FAMILY.factor[50 + k]))])
                        sig.append(pa.array((upto[sets.first[1:]] - upto[sets.first[:-1]]).view(np.int64)))
                bit = sets.text * PARITY_BITS + (sets.shingle >> np.uint64(64 - 9)).astype(np.int64)
                odd = np.bincount(bit, minlength=len(sets.size) * PARITY_BITS).astype(np.uint8) & 1
                words = np.packbits(odd).view(np.int64)
                parity = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, PARITY_BITS // 64, dtype=np.int32)), pa.array(words))
                kept = prefix.shingle[prefix.inside]
                border = np.concatenate([[0], np.cumsum(prefix.inside)])[sets.first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sets.size.astype(np.int64)), *sig,
                     pa.array(prefix.matches.astype(np.int32)), parity,
                     pa.array([kept[x:y].tobytes() for x, y in zip(border[:-1], border[1:])], pa.binary())],
                    names=["id", "said", "n", "sig_a", "sig_b", "matches", "parity", "prefix"])

    return docs.select("id", "text", F.xxhash64("text").alias("said")).mapInArrow(returning(run), "id bigint, said bigint, n bigint, sig_a bigint, sig_b bigint, matches int, parity array<bigint>, prefix binary")


def live_table(rows: DataFrame, n_blocks: int) -> DataFrame:
    """``id, said, n, sig_a, sig_b, matches`` of every document, with its ``live`` prefix shingles
    (those that occur elsewhere; null without any) and their ``places``."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "sig_a"), F.lit(n_blocks)))
    order = ("id", "sig_a", "sig_b", "said")

    def shingles(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(p, np.uint64) for p in docs.column("prefix").to_pylist()]
        return blocks.joined(parts, np.uint64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def ask(key: tuple, docs: pa.Table) -> pa.Table:
        keys, times = np.unique(shingles(blocks.in_order(docs, *order))[0], return_counts=True)
        return blocks.send(key[0].as_py(), keys, n_blocks, bits=times > 1)

    def live(_: int, docs: pa.Table, flags: pa.Table) -> pa.Table:
        docs = blocks.in_order(docs, *order)
        found, border = shingles(docs)
        keys, where = np.unique(found, return_inverse=True)
        again = blocks.answered(flags, 1, keys, n_blocks)[where]
        spans = list(zip(border[:-1], border[1:]))
        out = docs.select(["id", "said", "n", "sig_a", "sig_b", "matches", "parity"])
        tokens = [found[a:b][again[a:b]].tobytes() or None for a, b in spans]
        places = [np.flatnonzero(again[a:b]).astype(np.int32).tobytes() or None for a, b in spans]
        return out.append_column("live", pa.array(tokens, pa.binary())).append_column("places", pa.array(places, pa.binary()))

    asked = blocks.occurs_elsewhere(rows.groupBy("block").applyInArrow(ask, blocks.SENT))
    return blocks.with_answers(rows, asked, live, "id bigint, said bigint, n bigint, sig_a bigint, sig_b bigint, matches int, "
                                                  "parity array<bigint>, live binary, places binary")


def entries(prefixes: DataFrame) -> DataFrame:
    """One row per live prefix shingle: token, id, n, place, matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            places = [np.frombuffer(x, np.int32) for x in batch.column(4).to_pylist()]
            times = [len(x) for x in tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.joined(tokens, np.int64)), pa.array(blocks.joined(places, np.int32).astype(np.int64)),
                 *[pa.array(np.repeat(np.asarray(batch.column(c)).astype(np.int64), times)) for c in range(3)]],
                names=["token", "place", "id", "n", "matches"])

    return prefixes.select("id", "n", "matches", "live", "places").mapInArrow(
        returning(run), "token bigint, place bigint, id bigint, n bigint, matches bigint")


def verified(pairs: DataFrame, texts: DataFrame, width: int, t_num: int, t_den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(2)):
                part = batch.slice(at, end - at)
                x, y = Sets(part.column(2), width), Sets(part.column(3), width)
                row, shingle = np.concatenate([x.text, y.text]), np.concatenate([x.shingle, y.shingle])
                order = np.lexsort((shingle, row))
                row, shingle = row[order], shingle[order]
                same = (row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1])
                both = np.bincount(row[1:][same], minlength=part.num_rows)
                keep = t_den * both >= t_num * (x.size + y.size - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(returning(run), "a bigint, b bigint")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS,
            t_num: int = 80, t_den: int = 100, block_bytes: int = blocks.BLOCK_BYTES, with_first: bool = False) -> DataFrame:
    """Per document: ``id_col, n_shingles, component_id`` (smallest id reachable by links of
    Jaccard >= t_num / t_den) and, ``with_first``, ``said`` (xxhash64 of its text) and ``first``: does it
    have the smallest id of its component, and of the texts of that id in it the smallest hash?"""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    with blocks.small_batches(spark), blocks.scratch(spark) as keep:
        out = _similar(rows, keep, width, t_num, t_den, block_bytes).withColumnRenamed("id", id_col)
        return out if with_first else out.drop("said", "first")


def _similar(rows: DataFrame, keep, width: int, t_num: int, t_den: int, block_bytes: int) -> DataFrame:
    # prefixes hold about a fifth of the shingles, so a block takes the texts of two
    n_blocks = blocks.count_blocks(rows, "text", 2 * block_bytes)
    table = blocks.stored(live_table(prefixes(rows, width, t_num, t_den), n_blocks))

    # equal sets are one class; a class is a node of its own, whatever ids its documents have
    sig = ["n", "sig_a", "sig_b"]
    classes = table.where("n > 0 and id is not null").groupBy(*sig).agg(F.min(F.struct("id", "said")).alias("rep"))
    classes = blocks.stored(classes.select(*sig, F.col("rep.id").alias("rep"), F.col("rep.said").alias("rep_said"),
                                           F.monotonically_increasing_id().alias("node")))
    reps = table.where("live is not null and id is not null").join(classes, sig).where("id = rep and said = rep_said")
    reps = keep(reps.dropDuplicates(["node"]))
    own = reps.select(F.col("rep").alias("id"), F.col("rep_said").alias("said"), "node")
    reps = reps.drop("id", "said", "rep", "rep_said").withColumnRenamed("node", "id")

    # partners m of n share >= ceil(t (n + m) / (1 + t)) <= n - place + matches - 1
    hi = F.floor(F.lit(t_num + t_den) * (F.col("n") - F.col("place") + F.col("matches") - 1) / F.lit(t_num)) - F.col("n")
    step = float(np.log(t_den / t_num))
    size_class = lambda c: F.floor(F.log(c.cast("double")) / F.lit(step))
    all_entries = entries(reps).withColumn("hi", hi)
    least = F.ceil(F.col("n") * F.lit(t_num) / F.lit(t_den))
    most = F.least("n", "hi")
    index = all_entries.where("hi >= n").withColumn("class", size_class(F.col("n")))
    probe = all_entries.where(most >= least).withColumn(
        "class", F.explode(F.sequence(size_class(least), size_class(most))))

    def may_reach(x: str, y: str) -> Column:
        """Places whose parity differs are shingles that only one of the sets has: at most n + m - 2a."""
        differ = reduce(add, [F.bit_count(F.col(f"{x}.parity")[k].bitwiseXOR(F.col(f"{y}.parity")[k]))
                              for k in range(PARITY_BITS // 64)])
        total = F.col(f"{x}.n") + F.col(f"{y}.n")
        return differ <= total - 2 * F.ceil(total * F.lit(t_num) / F.lit(t_num + t_den))

    def sides(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class"))
                      & (F.col("y.n") <= F.col("x.n")) & (F.col("y.n") <= F.col("x.hi")) & (F.col("x.n") <= F.col("y.hi"))
                      & (F.col("y.n") * t_den >= F.col("x.n") * t_num)
                      & ((F.col("y.n") < F.col("x.n")) | (F.col("y.id") < F.col("x.id")))
                      & may_reach("x", "y"))

    # only lists of two or more documents matter, and only their members' texts are fetched, once
    lists = (probe.select("token", "class", "id").unionByName(index.select("token", "class", "id"))
             .groupBy("token", "class").agg(F.min("id").alias("lo"), F.max("id").alias("up")).where("lo <> up")
             .select("token", "class"))
    probe, index = (keep(d.join(lists, ["token", "class"])) for d in (probe, index))
    members = probe.select("id").unionByName(index.select("id")).distinct()
    wanted = own.join(members.withColumnRenamed("id", "node"), "node", "left_semi")
    texts = rows.withColumn("said", F.xxhash64("text")).join(wanted, ["id", "said"])
    texts = keep(texts.select(F.col("node").alias("id"), "text").dropDuplicates(["id"]))

    # the list's member with the fewest rare shingles in front of this one is its centre, among
    # the smaller and among the larger sides; a document is held against the centre it meets most
    meets = f"x.id <> y.id and y.n <= x.n and y.n <= x.hi and x.n <= y.hi and y.n * {t_den} >= x.n * {t_num}"

    def centre(d: DataFrame) -> DataFrame:
        return d.groupBy("token", "class").agg(F.min(F.struct("place", "id", "n", "hi", "matches")).alias("c")).select(
            "token", "class", "c.*")

    small = probe.alias("x").join(centre(index).alias("y"), ["token", "class"]).where(meets).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.least("x.matches", "y.matches").alias("asked"))
    large = index.alias("y").join(centre(probe).alias("x"), ["token", "class"]).where(meets).select(
        F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.least("x.matches", "y.matches").alias("asked"))
    often = small.unionByName(large).groupBy("a", "b").agg(
        F.count("*").alias("met"), F.min("asked").alias("asked")).where("met >= asked")
    star = keep(often.groupBy("a").agg(F.max(F.struct("met", (-F.col("b")).alias("b"))).alias("m")).select(
        "a", (-F.col("m.b")).alias("b")))
    first = keep(verified(star, texts, width, t_num, t_den))
    merged = components(first).select(F.col("node").alias("id"), "root")

    parity = reps.select("id", "parity")
    tagged = [d.join(merged, "id", "left").join(parity, "id").withColumn("comp", F.coalesce("root", "id")).drop("root")
              for d in (probe, index)]
    mixed = (tagged[0].select("token", "class", "comp").unionByName(tagged[1].select("token", "class", "comp"))
             .groupBy("token", "class").agg(F.min("comp").alias("lo"), F.max("comp").alias("up")).where("lo <> up")
             .select("token", "class"))
    left, right = (d.join(mixed, ["token", "class"]) for d in tagged)
    met = sides(left, right).where("x.comp <> y.comp").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count("*").alias("met"), F.min(F.least("x.matches", "y.matches")).alias("asked")).where("met >= asked")
    tried = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = keep(met.select("a", "b").join(tried, ["a", "b"], "left_anti"))
    roots = components(first.unionByName(verified(rest, texts, width, t_num, t_den)))

    label = classes.join(roots.withColumnsRenamed({"node": "linked"}), F.col("node") == F.col("linked"), "left")
    label = label.withColumn("root", F.coalesce("root", "node"))
    least = label.groupBy("root").agg(F.min(F.struct("rep", "rep_said")).alias("least"))
    label = label.join(least, "root").select(*sig, "least")
    out = table.select("id", "said", *sig).join(label, sig, "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("least.rep"))
    first = alone | ((F.col("id") == F.col("least.rep")) & (F.col("said") == F.col("least.rep_said")))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), "said", first.alias("first"))
