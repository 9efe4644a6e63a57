"""Helpers that several text operators share: typed empty batches, clash-free working columns, sizes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limnoscope.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(column: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), SPACE), "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for results that several later jobs read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def released(*frames: DataFrame | None) -> None:
    """Deletes the checkpoint files of settled tables (or plain selections of one) that nothing reads any more.

    A loop over settled tables would otherwise keep every round's files to the end of the session.
    """
    for df in frames:
        if df is None:
            continue
        context = df.sparkSession.sparkContext
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            file = leaves.apply(k).rdd().getCheckpointFile()
            if file.isDefined():
                path = context._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made inside go when each query ends, not when the session does.

    For operators of many jobs whose results are settled tables; a query that runs again shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
