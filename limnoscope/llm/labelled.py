"""Labelled rows to learn from: the hold-out rule and a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model sees; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most `max_rows` labelled ids outside the hold-out, in hash order: 16 bytes a row.

    An id with several labels counts as 1 if any of them is 1. Null ids and null labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label")).limit(max_rows)
    return picked.groupBy("doc_id").agg(F.max("label").alias("label"))
