"""Stored tables that are paged, searched and changed without reading them whole.

* A paged table is sorted by its key; a small table of its files holds each file's first and last key and its rows, so a
  page reads the few files that can hold it and the total needs no scan.
* A search table lists the three-letter parts of the searched columns, sorted, so a term reads only its own parts.
* A table in buckets keeps the rows of a key's hash together; a change reads and writes the buckets it names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limnoscope.functions.text import any_column_contains
from limnoscope.operators import tables
from limnoscope.session import cut_lineage

ROWS, FILES = "rows", "files"
BUCKET = "_bucket"
#: Letters of searched text whose parts go to one file: folding and sorting them takes some 100 MB of a task.
FILE_LETTERS = 1_000_000


# --- pages ---------------------------------------------------------------------------------------------------
def write_paged(table: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Sorted by key over files of like size, with the table of files beside it."""
    spread = table.repartitionByRange(files, key) if files else table.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.parquet(f"{path}/{ROWS}")
    stored = table.sparkSession.read.parquet(f"{path}/{ROWS}").select(key, F.col("_metadata.file_path").alias("file"))
    listed = stored.groupBy("file").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
    listed.coalesce(1).write.parquet(f"{path}/{FILES}")


def total_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row `total`, from the table of files."""
    return spark.read.parquet(f"{path}/{FILES}").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def seek_page(spark: SparkSession, path: str, key: str, limit: int, before=None) -> DataFrame:
    """The next `limit` rows below the key `before` (None: from the newest), newest key first.

    Every file but the one that `before` falls into counts in full, so at most `limit` + 1 of them are looked at.
    """
    listed = spark.read.parquet(f"{path}/{FILES}")
    if before is not None:
        listed = listed.where(F.col("low") < F.lit(before))
    chosen, held = [], 0
    for f in listed.orderBy(F.desc("high"), F.desc("low")).limit(limit + 1).collect():
        if held >= limit:
            break
        chosen.append(f.file)
        held += f.n if before is None or f.high < before else 0
    stored = spark.read.parquet(f"{path}/{ROWS}")
    rows = spark.read.schema(stored.schema).parquet(*chosen) if chosen else stored.limit(0)
    if before is not None:
        rows = rows.where(F.col(key) < F.lit(before))
    return rows.orderBy(F.desc(key)).limit(limit)


# --- search --------------------------------------------------------------------------------------------------
def _parts(text: Column) -> Column:
    """Distinct three-letter parts of a lower-cased text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def search_parts(table: DataFrame, key: str, columns: Sequence[str], files: int | None = None) -> DataFrame:
    """Distinct (part, key) of the searched columns, sorted by part. A part of very many rows is split over tasks.

    A file of narrow rows is one split, so the rows are dealt out before they are cut up, and parts are folded only in the
    range of (part, key) that they belong to. There are as many ranges as the texts need, so none grows with the table.
    """
    rows = table.select(F.col(key), F.array(*[F.col(c).cast("string") for c in columns]).alias("_texts"))
    dealt = rows.repartition(key, "_texts").distinct()
    texts = dealt.select(key, F.explode("_texts").alias("_text")).where(F.length("_text") >= 3)
    parts = texts.select(key, F.explode(_parts(F.col("_text"))).alias("part"))
    if files is None:
        letters = texts.agg(F.sum(F.length("_text"))).first()[0] or 0
        files = 1 + letters // FILE_LETTERS
    spread = parts.repartitionByRange(files, "part", key)
    return spread.distinct().sortWithinPartitions("part", key)


def write_search_parts(table: DataFrame, path: str, key: str, columns: Sequence[str], files: int | None = None) -> None:
    """The table of `search_parts`, written."""
    search_parts(table, key, columns, files).write.parquet(path)


def term_parts(term: str) -> list[str]:
    """Three-letter parts that every text matching the term holds; `%` and `_` are wildcards and end a run."""
    runs = [r.lower() for r in re.split("[%_]", term)]
    return sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})


def search_by_parts(table: DataFrame, parts_path: str, key: str, columns: Sequence[str], term: str) -> DataFrame:
    """Rows of `table` with the term in one of the columns, as `tables.search` finds them.

    Only rows that hold all parts of the term are read up and checked; a term without three letters in a row is searched
    for in the whole table.
    """
    wanted = term_parts(term)
    if not wanted:
        return tables.search(table, term, columns)
    parts = table.sparkSession.read.parquet(parts_path).where(F.col("part").isin(*wanted))
    # A common part names very many rows in few files; they are dealt out before they are counted.
    dealt = parts.where(F.col(key).isNotNull()).repartition(key)
    holding = dealt.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select(key)
    return table.join(holding, key, "left_semi").where(any_column_contains(columns, term))


# --- changes -------------------------------------------------------------------------------------------------
def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_buckets(table: DataFrame, path: str, key: str, buckets: int) -> None:
    """One folder per bucket of the key's hash."""
    placed = table.withColumn(BUCKET, _bucket(key, buckets))
    placed.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def change_buckets(
    spark: SparkSession,
    path: str,
    key: str,
    buckets: int,
    updates: DataFrame | None = None,
    deletes: DataFrame | None = None,
    inserts: DataFrame | None = None,
    order: str | None = None,
) -> list[int]:
    """Update, delete and insert rows by key; only the buckets of the named keys are read and rewritten. Those are returned.

    Updates come first, deletes next, inserts last. The new rows are settled in the shared folder before the old ones are
    replaced, bucket by bucket; buckets whose rows are all gone lose their folder.
    """
    given = [df.select(_bucket(key, buckets).alias(BUCKET)) for df in (updates, deletes, inserts) if df is not None]
    touched = sorted({r[BUCKET] for df in given for r in df.distinct().collect()})
    if not touched:
        return []
    stored = spark.read.parquet(path)
    rows = stored.where(F.col(BUCKET).isin(*touched)).drop(BUCKET)
    if updates is not None:
        rows = tables.update_rows(rows, updates, key, order)
    if deletes is not None:
        rows = tables.delete_rows(rows, deletes, key)
    if inserts is not None:
        rows = tables.insert_rows(rows, inserts)
    after = cut_lineage(rows.withColumn(BUCKET, _bucket(key, buckets)))
    left = {r[BUCKET] for r in after.select(BUCKET).distinct().collect()}
    if left:
        writer = after.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    context = spark.sparkContext
    for gone in sorted(set(touched) - left):
        place = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={gone}")
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    spark.catalog.refreshByPath(path)
    return touched
