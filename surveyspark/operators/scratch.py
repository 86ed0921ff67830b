"""Tables that a job stores on its way, so that its disk holds little at a time.

What a job shuffled lies on the executors' disks until the driver happens to collect its garbage. A step whose
rows are stored reads it no more: the step's shuffle files are removed when its job ends. Tables that no result
reads are removed with their folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What jobs in here shuffle is removed at their end; a plan that runs once more shuffles once more."""
    before = spark.conf.get(_REMOVED, None)
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVED)
        else:
            spark.conf.set(_REMOVED, before)


def stored_table(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a packed table of columns in the shared checkpoint folder, which cuts their lineage. It is joined
    by sort and merge: packed files say little about the size of their rows, so none is broadcast for them."""
    spark = df.sparkSession
    path = f"{folder or checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


class Scratch:
    """Tables that only the steps in a ``with`` read: removed when it ends. What is still to be read by a result
    is stored by ``stored_table``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def store(self, df: DataFrame) -> DataFrame:
        return stored_table(df, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.drop()

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
