"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in two halves with a codebook each; a cell is a pair of centroids. Every
vector lies in its nearest cell and visits the other cells by the multi-sequence traversal
(nearest pair of centroids first) up to a cost that is fitted so that the wanted share of
neighbours at exactly the threshold is met in one direction; a pair is found when either side
finds the other. What a visit meets is verified by cosine in double precision.

Equal vectors are one class with a multiplicity, so a large group of copies is one entry. Cells
are cut into pieces of bounded size on both sides, a task compares two pieces, and sends link
counts and a spanning forest, never pairs.

Vectors of different length never link: every length has cells and an index of its own, however
few vectors have it. A vector is first scaled by a power of two, so that neither its norm nor a
product of two norms leaves the range of doubles.

Bounds: the codebooks of a length are fitted on ``SAMPLE`` of its vectors (the smallest by hash),
all vectors are indexed; at most ``MAX_CENTROIDS`` per half.

Edge cases: null, empty, zero and non-finite vectors and those with a null component link with
nothing; of a vector with one component only the sign counts; repeated rows are one class
(each row keeps its id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.components import components
from surveyspark.session import cut_lineage

SAMPLE = 8192
MAX_CENTROIDS = 512
PER_CELL = 16  # wanted vectors per cell, as long as the centroids last
RECALL = 0.98  # one-directional, for neighbours at exactly the threshold
DRAWS = 4096  # neighbours at the threshold, at least, from which the cost of visits is fitted
PIECE = 2048  # vectors of a cell compared at once


def unpack(col: pa.Array) -> np.ndarray:
    """Matrix of packed vectors, in double precision and unit length."""
    if not len(col):
        return np.zeros((0, 1))
    x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in col])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(rows: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as bytes of doubles, null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float64)
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                x = np.ldexp(x, -np.frexp(np.abs(x).max())[1]) if ok else x  # exact
                x = np.sign(x) if ok and len(x) == 1 else x
                out.append((x + 0.0).tobytes() if ok else None)  # + 0.0: one kind of zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id bigint, x binary")


class MultiIndex:
    """Two codebooks and the cost up to which cells are visited."""

    def __init__(self, sample: np.ndarray, centroids: int, least: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [_centroids(sample[:, :self.half], centroids), _centroids(sample[:, self.half:], centroids)]
        rng = np.random.default_rng(5)
        sample = np.tile(sample, (-(-min(DRAWS, len(sample) * DRAWS) // len(sample)), 1))
        other = rng.standard_normal(sample.shape)
        other -= (other * sample).sum(1, keepdims=True) * sample
        size = np.linalg.norm(other, axis=1, keepdims=True)
        near = least * sample + np.sqrt(max(0.0, 1 - least * least)) * other / np.where(size > 0, size, 1)
        one, two = self.costs(sample)
        a, b = (c.argmin(1) for c in self.costs(near))
        rows = np.arange(len(sample))
        beyond = one[rows, a] + two[rows, b] - one.min(1) - two.min(1)
        self.reach = float(np.quantile(beyond, recall, method="higher")) + 1e-9

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to the centroids; the same numbers for a vector
        whatever else is in ``x``."""
        out = []
        for part, book in zip((x[:, :self.half], x[:, self.half:]), self.books):
            step = max(1, (4 << 20) // max(1, book.size))
            out.append(np.concatenate([((part[k:k + step, None, :] - book[None]) ** 2).sum(-1)
                                       for k in range(0, len(part), step)] or [np.zeros((0, len(book)))]))
        return out[0], out[1]

    def cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.books[1]) + b

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(own cell, visited cells, nearest first) for every row."""
        one, two = self.costs(x)
        for r in range(len(x)):
            d, e = one[r], two[r]
            i, j = np.argsort(d, kind="stable"), np.argsort(e, kind="stable")
            limit = d.min() + e.min() + self.reach
            heap, out = [(d[i[0]] + e[j[0]], 0, 0)], []
            while heap and heap[0][0] <= limit:
                _, p, q = heapq.heappop(heap)
                out.append(int(self.cell(i[p], j[q])))
                if q + 1 < len(j):
                    heapq.heappush(heap, (d[i[p]] + e[j[q + 1]], p, q + 1))
                if q == 0 and p + 1 < len(i):
                    heapq.heappush(heap, (d[i[p + 1]] + e[j[0]], p + 1, 0))
            yield int(self.cell(d.argmin(), e.argmin())), out

    def sees(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Does row r visit cells[r]?"""
        one, two = self.costs(x)
        rows, n = np.arange(len(x)), len(self.books[1])
        return one[rows, cells // n] + two[rows, cells % n] <= one.min(1) + two.min(1) + self.reach


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means from a fixed start."""
    start = np.random.default_rng(3).permutation(len(x))[:k]
    book = x[start].copy()
    for _ in range(rounds):
        near = ((book ** 2).sum(1)[None] - 2 * x @ book.T).argmin(1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def _labels(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and each column reaches through ``hit``."""
    top = np.iinfo(np.int64).max
    while True:
        low = np.where(hit, right[None], top).min(1, initial=top)
        new_left = np.minimum(left, low)
        new_right = np.minimum(right, np.where(hit, new_left[:, None], top).min(0, initial=top))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
                    recall: float = RECALL, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """Per vector: ``id_col, n_links, component_id, kept``."""
    vectors = cut_lineage(packed(rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))))
    classes = vectors.where("x is not null and vec_id is not null").groupBy("x").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("times"))
    sizes = {r["width"]: r["n"] for r in classes.groupBy(F.length("x").alias("width")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.select(F.col("vec_id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                              F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    indexes: dict[int, MultiIndex] = {}
    first, n_cells = {}, 0  # the cells of a length are numbered from first[length]
    for width, n in sorted(sizes.items()):
        known = unpack(classes.where(F.length("x") == width).select("x").orderBy(F.xxhash64("x"), "x").limit(sample)
                       .toArrow().column("x").combine_chunks())
        centroids = int(np.clip(np.ceil(np.sqrt(n / PER_CELL)), 2, MAX_CENTROIDS))
        indexes[width], first[width] = MultiIndex(known, min(centroids, len(known)), least, recall), n_cells
        n_cells += len(indexes[width].books[0]) * len(indexes[width].books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                whole = batch.slice(at, 1024)
                widths = pc.binary_length(whole.column(1))
                for width in pc.unique(widths).to_pylist():
                    part = whole.filter(pc.equal(widths, width))
                    index, base = indexes[width], first[width]
                    cells, seen = zip(*((base + own, [base + c for c in met]) for own, met in index.visits(unpack(part.column(1)))))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.array(cells, pa.int64()),
                         pa.array(list(seen), pa.list_(pa.int64()))], names=["id", "x", "times", "home", "seen"])

    placed = cut_lineage(classes.select("id", "x", "times").mapInArrow(
        assign, "id bigint, x binary, times bigint, home bigint, seen array<bigint>"))
    probes = placed.select("id", "x", "times", "home", F.explode("seen").alias("cell"))
    pieces = lambda c: F.ceil(c / F.lit(piece)).cast("int")
    cells = (placed.groupBy(F.col("home").alias("cell")).agg(pieces(F.count("*")).alias("home_pieces"))
             .join(probes.groupBy("cell").agg(pieces(F.count("*")).alias("probe_pieces")), "cell"))
    if n_cells <= MAX_CENTROIDS ** 2:
        cells = F.broadcast(cells)  # rows of 16 bytes
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = (placed.withColumn("cell", F.col("home")).join(cells, "cell").withColumn("s", part("home_pieces", 1))
             .withColumn("t", spread("probe_pieces"))
             .select(F.col("cell").alias("home_cell"), "s", "t", *[F.col(c).alias(f"home_{c}") for c in ("id", "x", "times")]))
    probes = (probes.join(cells, "cell").withColumn("t", part("probe_pieces", 2)).withColumn("s", spread("home_pieces"))
              .select("cell", "s", "t", "id", "x", "times", "home"))

    def compare(probe: pa.Table, home: pa.Table) -> pa.Table:
        probe, home = probe.combine_chunks(), home.combine_chunks()
        ids, times, own = (np.asarray(probe.column(c)) for c in ("id", "times", "home"))
        there, there_times = np.asarray(home.column("home_id")), np.asarray(home.column("home_times"))
        y = unpack(home.column("home_x").combine_chunks())
        index, base = indexes.get(8 * y.shape[1]), first.get(8 * y.shape[1], 0)  # none if there is nothing to compare
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for at in range(0, len(ids) if len(there) else 0, piece):
            x = unpack(probe.column("x").combine_chunks().slice(at, piece))
            part_ids = ids[at:at + piece]
            hit = (x @ y.T >= least) & (part_ids[:, None] != there[None])
            p, h = np.nonzero(hit)
            if not len(p):
                continue
            # a pair that either side finds is counted where the smaller id probes
            mutual = np.ones(len(p), bool)
            for k in range(0, len(p), 4096):
                mutual[k:k + 4096] = index.sees(y[h[k:k + 4096]], own[at + p[k:k + 4096]] - base)
            once = ~mutual | (part_ids[p] < there[h])
            for who, n in ((part_ids[p[once]], there_times[h[once]]), (there[h[once]], times[at + p[once]])):
                found, back = np.unique(who, return_inverse=True)
                for i, total in zip(found.tolist(), np.bincount(back, n).astype(np.int64).tolist()):
                    links[i] = links.get(i, 0) + total
            rows_hit, cols_hit = np.unique(p), np.unique(h)
            left, right = _labels(hit[np.ix_(rows_hit, cols_hit)], part_ids[rows_hit], there[cols_hit])
            for a, b in ((part_ids[rows_hit], left), (there[cols_hit], right)):
                edges += [(i, r) for i, r in zip(a.tolist(), b.tolist()) if i != r]
        kind = [0] * len(links) + [1] * len(edges)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array([*links, *(a for a, _ in edges)], pa.int64()),
                         "b": pa.array([*links.values(), *(b for _, b in edges)], pa.int64())})

    found = cut_lineage(probes.groupBy("cell", "s", "t").cogroup(homes.groupBy("home_cell", "s", "t")).applyInArrow(
        compare, "kind int, a bigint, b bigint"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("met"))
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "id")
    judged = classes.join(links, "id", "left").join(roots, "id", "left").select(
        "x", (F.coalesce("met", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    usable = vectors.where("x is not null").join(judged, "x", "left")
    rest = vectors.where("x is null").select("*", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    out = usable.unionByName(rest)
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
