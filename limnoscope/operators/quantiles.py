"""Exact grouped statistics and quantiles that survive very large groups.

Spark's `percentile` keeps every distinct value of a group in one task. That is right for small groups,
so groups are counted first and only those above a bound take another way: equal values are counted
(partial aggregation, spread by key and value), approximate quantiles cut the group into slices, the slices' sizes tell
which one holds each wanted rank, and only that slice is ordered, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnoscope.operators.sizing import lookup_join
from limnoscope.session import cut_lineage

# Rows of a group whose values one task may hold.
SMALL_GROUP_ROWS = 1_000_000

# Slices of a large group: their ends are the group's own approximate quantiles, so a group of nearly equal values and
# one with far outliers are cut alike. Ends are looked up in two steps of `_STEP`.
_STEP = 32
_SLICES = _STEP * _STEP
# Bounds of so many groups (8 KB each) are sent to all tasks; those of more groups are joined.
_SENT_GROUPS = 2_000


def with_slices(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `_slice`, which never decreases when the value grows; each holds about one `_SLICES`th of the distinct values."""
    shares = [k / _SLICES for k in range(_SLICES)]
    bounds = cut_lineage(counts.groupBy(*keys).agg(F.percentile_approx("_value", shares, 20 * _SLICES).alias("_bounds")))
    bounds = bounds.withColumn("_heads", F.transform(F.sequence(F.lit(0), F.lit(_STEP - 1)), lambda i: F.get(F.col("_bounds"), i * _STEP)))
    joined = lookup_join(counts, bounds, list(keys), ["_value"], max_rows=_SENT_GROUPS)
    head = F.greatest(F.size(F.filter("_heads", lambda x: x <= F.col("_value"))) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice("_bounds", head * _STEP + 1, F.lit(_STEP)), lambda x: x <= F.col("_value")))
    return joined.withColumn("_slice", (head * _STEP + inside).cast("long")).drop("_bounds", "_heads")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value); NULL and NaN values are left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))


def grouped_distribution(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
    small_group_rows: int = SMALL_GROUP_ROWS,
) -> DataFrame:
    """One row per group: `n_obs`, `value_mean`, `value_min`, `value_max` and the named quantiles.

    Quantiles interpolate linearly between neighbouring order statistics.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumnRenamed(value, "_value")
    return _by_group_size(
        rows, keys, F.lit(1), probabilities, small_group_rows, lambda hot: value_counts(hot, keys, "_value")
    )


def distribution_from_counts(
    counts: DataFrame, keys: Sequence[str], probabilities: dict[str, float], small_group_rows: int = SMALL_GROUP_ROWS
) -> DataFrame:
    """The same from rows (keys, _value, _n) that count equal values."""
    return _by_group_size(counts, keys, F.col("_n"), probabilities, small_group_rows, lambda hot: hot)


def _by_group_size(rows, keys, weight, probabilities, small_group_rows, counted) -> DataFrame:
    """Hot groups by slices, the others by one aggregation."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # At most one group per `small_group_rows` rows; written once, as both branches read it.
    hot = cut_lineage(sizes.where(F.col("_rows") > small_group_rows).select(*keys))
    if hot.isEmpty():
        return _small_groups(rows, keys, weight, probabilities)
    cold_rows = lookup_join(rows, hot, keys, ["_value"], how="left_anti")
    hot_rows = lookup_join(rows, hot, keys, ["_value"], how="left_semi")
    small = _small_groups(cold_rows, keys, weight, probabilities)
    return small.unionByName(_by_slices(counted(hot_rows), keys, probabilities))


def _small_groups(rows: DataFrame, keys: list[str], weight: Column, probabilities: dict[str, float]) -> DataFrame:
    shares = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    stats = rows.groupBy(*keys).agg(
        F.sum(weight).cast("long").alias("n_obs"),
        (F.sum(F.col("_value") * weight) / F.sum(weight)).alias("value_mean"),
        F.min("_value").alias("value_min"),
        F.max("_value").alias("value_max"),
        F.percentile(F.col("_value"), shares, weight).alias("_q"),
    )
    return stats.select(
        *keys, "n_obs", "value_mean", "value_min", "value_max",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)],
    )


def _by_slices(counts: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    keys = list(keys)
    sliced = with_slices(cut_lineage(counts), keys)
    slices = sliced.groupBy(*keys, "_slice").agg(
        F.sum("_n").alias("_size"),
        F.sum(F.col("_value") * F.col("_n")).alias("_sum"),
        F.min("_value").alias("_min"),
        F.max("_value").alias("_max"),
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slices.select(
        *keys, "_slice",
        F.sum("_size").over(upto).alias("_upto"),
        F.col("_size"),
        F.sum("_size").over(group).alias("n_obs"),
        F.sum("_sum").over(group).alias("_total"),
        F.min("_min").over(group).alias("value_min"),
        F.max("_max").over(group).alias("value_max"),
    )
    # Two order statistics per quantile, each lying in exactly one slice.
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    (F.floor((F.col("n_obs") - 1) * F.lit(float(p))) + side).cast("long").alias("rank"),
                    F.lit(side).alias("side"),
                    ((F.col("n_obs") - 1) * F.lit(float(p))
                     - F.floor((F.col("n_obs") - 1) * F.lit(float(p)))).alias("share"),
                )
                for name, p in probabilities.items()
                for side in (1, 2)
            ]
        )
    )
    targets = (
        placed.withColumn("_t", wanted)
        .withColumn("_rank", F.least(F.col("_t.rank"), F.col("n_obs")))
        .where((F.col("_rank") > F.col("_upto") - F.col("_size")) & (F.col("_rank") <= F.col("_upto")))
        .select(
            *keys, "_slice", "n_obs", "_total", "value_min", "value_max", "_rank",
            (F.col("_upto") - F.col("_size")).alias("_ahead"),
            F.col("_t.name").alias("_name"), F.col("_t.side").alias("_side"), F.col("_t.share").alias("_share"),
        )
    )
    within = Window.partitionBy(*keys, "_slice", "_name", "_side").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = (
        sliced.join(targets, [*keys, "_slice"])
        .withColumn("_cum", F.col("_ahead") + F.sum("_n").over(within))
        .where((F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_n")))
    )
    pick = lambda name, side: F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_value")))
    share = lambda name: F.max(F.when(F.col("_name") == name, F.col("_share")))
    return found.groupBy(*keys).agg(
        F.max("n_obs").alias("n_obs"),
        (F.max("_total") / F.max("n_obs")).alias("value_mean"),
        F.max("value_min").alias("value_min"),
        F.max("value_max").alias("value_max"),
        *[
            (pick(n, 1) + (pick(n, 2) - pick(n, 1)) * share(n)).alias(n)
            for n in probabilities
        ],
    )


def iqr_fence(df: DataFrame, keys: Sequence[str], value: str, width: float = 1.5) -> DataFrame:
    """Quartiles and the fence `width` inter-quartile ranges beyond them, per group."""
    q = grouped_distribution(df, keys, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select(
        *keys, "n_obs", "q1", "q3",
        (F.col("q1") - spread * width).alias("low"),
        (F.col("q3") + spread * width).alias("high"),
    )
