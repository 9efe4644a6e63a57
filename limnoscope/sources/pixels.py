"""The stored pixel and scene tables.

Pixels are partitioned by `scene_month`; inside a file rows are sorted by reservoir and scene, so that
row-group statistics prune a search for one reservoir.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnoscope.functions.temporal import day_range
from limnoscope.schemas import SCENE_KEYS


def _month(day) -> F.Column:
    return F.date_format(day, "yyyy-MM")


def write_pixels(pixels: DataFrame, path: str, mode: str = "append") -> None:
    """Rebalanced by month and reservoir: small groups share a file, a hot reservoir is split over many."""
    stored = pixels.withColumn("scene_month", _month(F.col("scene_date")))
    (
        stored.hint("rebalance", "scene_month", "reservoir_id")
        .sortWithinPartitions("scene_month", *SCENE_KEYS)
        .write.mode(mode)
        .partitionBy("scene_month")
        .parquet(path)
    )


def read_pixels(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    reservoirs: Sequence[int] | None = None,
    inclusive_end: bool = False,
) -> DataFrame:
    """Pixels of a date range; whole months outside it are not listed for reading."""
    stored = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    stored = stored.withColumn("scene_month", F.col("scene_month").cast("string"))
    if start is not None:
        stored = stored.where(F.col("scene_month") >= start[:7])
    if end is not None:
        stored = stored.where(F.col("scene_month") <= end[:7])
    if start is not None and end is not None:
        stored = stored.where(day_range(F.col("scene_date"), start, end, inclusive_end))
    elif start is not None:
        stored = stored.where(F.col("scene_date") >= F.lit(start).cast("date"))
    elif end is not None:
        bound = F.lit(end).cast("date")
        stored = stored.where((F.col("scene_date") <= bound) if inclusive_end else (F.col("scene_date") < bound))
    if reservoirs is not None:
        stored = stored.where(F.col("reservoir_id").isin(*reservoirs))
    return stored.drop("scene_month")


def write_scene_table(scenes: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Store per-scene figures once; screening, products and calibration start from them."""
    scenes.hint("rebalance").write.mode(mode).parquet(path)
    return scenes.sparkSession.read.parquet(path)
