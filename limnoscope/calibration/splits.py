"""Reproducible train, test and fold assignment by hash order.

A row is ranked by the md5 of its key, which any engine computes alike. Ranks are taken inside hash
buckets and shifted, so a group of any size is split over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.operators.quantiles import iqr_fence
from limnoscope.operators.sizing import lookup_join, spread_row_number
from limnoscope.session import cut_lineage

GROUP = ("reservoir_id", "variable")
TEST_SHARE, SMALL_TEST_SHARE, SMALL_GROUP = 0.25, 0.20, 8
OUTLIER_MIN_TRAIN = 8
HELD_OUT, REMOVED = -1, -2


def row_hash(salt: str, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys]))


def hash_rank(
    df: DataFrame, group: Sequence[str], salt: str, keys: Sequence[str], out: str, total: str | None = None
) -> DataFrame:
    hashed = df.withColumn("_h", row_hash(salt, keys))
    ranked = spread_row_number(hashed, group, F.substring("_h", 1, 3), ["_h", *keys], out, total)
    return ranked.drop("_h")


def holdout_split(
    rows: DataFrame, group: Sequence[str] = GROUP, key: Sequence[str] = (*GROUP, "date"), test_share: float = TEST_SHARE
) -> DataFrame:
    """Add `split`: the first ceil(n * share) rows in hash order are the test rows."""
    ranked = hash_rank(rows, group, "holdout", key, "_rank", "_total")
    share = F.when(F.col("_total") < SMALL_GROUP, F.lit(SMALL_TEST_SHARE)).otherwise(F.lit(float(test_share)))
    is_test = F.col("_rank") <= F.ceil(F.col("_total") * share)
    return ranked.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_rank", "_total")


def mark_outliers(rows: DataFrame, group: Sequence[str] = GROUP, value: str = "y_true") -> DataFrame:
    """Turn train rows beyond the 1.5 IQR fence of their group into split `outlier`, when it has 8 train rows."""
    train = rows.where(F.col("split") == "train")
    fence = iqr_fence(train, group, value).where(F.col("n_obs") >= OUTLIER_MIN_TRAIN)
    fence = fence.select(*group, "low", "high")
    joined = lookup_join(rows, fence, list(group), [*group, "date"], how="left")
    beyond = (F.col("split") == "train") & ((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))
    return joined.withColumn("split", F.when(beyond, "outlier").otherwise(F.col("split"))).drop("low", "high")


def kfold(rows: DataFrame, folds: int = 5, group: Sequence[str] = GROUP, key: Sequence[str] = (*GROUP, "date")) -> DataFrame:
    """Add `fold` 0..k-1 in hash order; k shrinks to the group size."""
    ranked = hash_rank(rows, group, "kfold", key, "_rank", "_total")
    k = F.least(F.lit(folds).cast("long"), F.col("_total"))
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_total")


def time_blocks(
    rows: DataFrame, folds: int = 5, group: Sequence[str] = GROUP, day: str = "date", ties: Sequence[str] = ()
) -> DataFrame:
    """Add `block` by time: block c is tested after training on all earlier blocks; 0 is only trained on."""
    ranked = spread_row_number(
        rows, group, F.date_trunc("month", day), [day, *ties], "_rank", "_total"
    )
    k = F.least(F.lit(folds).cast("long"), F.greatest(F.lit(2).cast("long"), F.col("_total") - 1))
    size = F.floor(F.col("_total") / (k + 1))
    first = F.col("_total") - k * size
    position = F.col("_rank") - 1
    block = F.when(position < first, F.lit(0)).otherwise(F.floor(F.try_divide(position - first, size)) + 1)
    return ranked.withColumn("block", block.cast("int")).drop("_rank", "_total")


def assign_parts(
    rows: DataFrame, scheme: str = "kfold", folds: int = 5, group: Sequence[str] = GROUP,
    key: Sequence[str] = (*GROUP, "date"), remove_outliers: bool = True,
) -> DataFrame:
    """Split, outliers and folds in one table: `part` is the fold, -1 for held-out, -2 for outlier rows.

    Each step ranks the rows of the one before, so the (small) tables between them are checkpointed.
    """
    split = cut_lineage(holdout_split(rows, group, key))
    if remove_outliers:
        split = cut_lineage(mark_outliers(split, group))
    train = split.where(F.col("split") == "train")
    if scheme == "timeseries":
        folded = time_blocks(train, folds, group, ties=key).withColumnRenamed("block", "part")
    elif scheme == "kfold":
        folded = kfold(train, folds, group, key).withColumnRenamed("fold", "part")
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    rest = split.where(F.col("split") != "train").withColumn(
        "part", F.when(F.col("split") == "test", F.lit(HELD_OUT)).otherwise(F.lit(REMOVED))
    )
    return folded.unionByName(rest)
