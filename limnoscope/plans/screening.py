"""Which dates of a range can be used, for all reservoirs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limnoscope.functions.temporal import day_range
from limnoscope.operators import screening, spatial


def usable_dates(
    pixels: DataFrame,
    start: str,
    end: str,
    aoi: DataFrame | None = None,
    max_cloud: float = 60,
    min_coverage: float = 50,
    inclusive_end: bool = False,
) -> DataFrame:
    """(reservoir, date, cloud share) in order; store it once and reuse it as the list of valid dates."""
    found = pixels.where(day_range(F.col("scene_date"), start, end, inclusive_end))
    if aoi is not None:
        found = spatial.clip_to_aoi(found, aoi)
    scenes = screening.scene_statistics(found)
    return screening.valid_dates(scenes, max_cloud, min_coverage).orderBy("reservoir_id", "scene_date")
