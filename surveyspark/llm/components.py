"""Connected components of a link table, without a driver-side graph or a hot group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.session import cut_lineage


def contract(links: DataFrame) -> DataFrame:
    """Replaces the links (a, b) of every partition by a spanning star forest of them
    (a -> smallest id of its tree). Memory is bounded by a partition's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        star = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in star], pa.int64()),
                                          pa.array([r for _, r in star], pa.int64())], names=["a", "b"])

    return links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(run, "a bigint, b bigint")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.withColumnRenamed("low", "b")).distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) other than the roots: root is the
    smallest node reachable. Self links and null ends are ignored; an empty table gives an
    empty table. Alternates the large-star and small-star steps; a round cuts its lineage in
    the shared checkpoint folder, and stops when the links are stars."""
    e = cut_lineage(contract(links.where("a <> b")).distinct())
    before = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, e = now, cut_lineage(_small_star(_large_star(e)))
    raise RuntimeError("components did not settle")
