"""Joins to lookup tables whose size is checked, and ranks that split large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Lookup rows are narrow (a few numbers and a name), so this many stay well under 100 MB.
BROADCAST_ROWS = 500_000
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most one row more than the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_from: Sequence[str],
    residual: Column | None = None,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi join that spreads each key of the big side over `salts` tasks.

    The salt is a hash of row values, so a task that runs again puts its rows where they were.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _equi_join(left, right, [*on, "_salt"], residual, how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_from: Sequence[str],
    residual: Column | None = None,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a lookup table: broadcast after its rows were counted, salted beyond the bound."""
    if is_small(small, max_rows):
        return _equi_join(big, F.broadcast(small), on, residual, how)
    return salted_join(big, small, on, salt_from, residual, how)


def _equi_join(left: DataFrame, right: DataFrame, on, residual, how) -> DataFrame:
    if residual is None:
        return left.join(right, list(on), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = residual
    for key in on:
        condition = condition & (F.col(key) == F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


def spread_row_number(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str, total: str | None = None
) -> DataFrame:
    """`row_number` over `keys` ordered by (`bucket`, *order), no group passing through one task.

    `bucket` must not decrease along the wanted order. Rows are ranked inside (keys, bucket) and
    shifted by the number of rows in the lower buckets, which come from a partial aggregation.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*keys)
    ahead = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        *keys, "_bucket",
        (F.sum("_size").over(ahead) - F.col("_size")).alias("_ahead"),
        F.sum("_size").over(group).alias("_group_size"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    # Rows of a NULL key are a group like any other.
    names = {k: f"_o_{k}" for k in [*keys, "_bucket"]}
    same = F.lit(True)
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    ranked = rows.join(offsets.withColumnsRenamed(names), same).drop(*names.values()).withColumn(
        out, F.col("_ahead") + F.row_number().over(inside)
    )
    if total:
        ranked = ranked.withColumnRenamed("_group_size", total)
    return ranked.drop("_bucket", "_ahead", "_group_size")
