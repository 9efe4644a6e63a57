"""Sensor table, multi-band product and new table versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from limnoscope.functions import spectral
from limnoscope.functions.text import safe_band_name
from limnoscope.operators.regrid import regrid
from limnoscope.operators.spatial import clip_to_aoi
from limnoscope.schemas import SCENE_KEYS


def append_sensor_rows(rows: DataFrame, path: str) -> None:
    """Append to the sensor table, one folder per reservoir, sorted by time inside a file."""
    (
        rows.hint("rebalance", "reservoir_code")
        .sortWithinPartitions("reservoir_code", "date_time")
        .write.mode("append")
        .partitionBy("reservoir_code")
        .parquet(path)
    )


def write_version(table: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a changed table to a new folder; a folder that is being read is never overwritten."""
    table.hint("rebalance", *partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def product_bands(
    pixels: DataFrame, names: Sequence[str], aoi: DataFrame | None = None, scale: float | None = None, classes: Sequence[str] = ()
) -> DataFrame:
    """Chosen index bands of every pixel in the area, under file-safe names.

    With `scale`, they come on a grid of that width: mean bands and commonest classes, or the nearest pixel on a finer grid.
    """
    clipped = clip_to_aoi(pixels, aoi) if aoi is not None else pixels
    spectral.check_bands(clipped, names)
    safe = {n: safe_band_name(n) for n in names}
    bands = clipped.select(
        *SCENE_KEYS, "x", "y", "area_m2", *[spectral.index_column(n).alias(b) for n, b in safe.items()], *classes,
    )
    return bands if scale is None else regrid(bands, list(safe.values()), scale, classes)


def export_product(
    pixels: DataFrame, names: Sequence[str], path: str, aoi: DataFrame | None = None, scale: float | None = None, classes: Sequence[str] = ()
) -> None:
    """One folder per date."""
    (
        product_bands(pixels, names, aoi, scale, classes)
        .hint("rebalance", "scene_date")
        .write.mode("errorifexists")
        .partitionBy("scene_date")
        .parquet(path)
    )
