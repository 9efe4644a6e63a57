"""From pixels to the result tables of a date range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from limnoscope.functions import masks
from limnoscope.operators import reduction, reshape, screening, spatial
from limnoscope.session import cut_lineage


def product_records(
    pixels: DataFrame,
    names: Sequence[str],
    points: DataFrame | None = None,
    aoi: DataFrame | None = None,
    bins: Mapping[str, Sequence[float]] | None = None,
    max_cloud: float = 60,
    min_coverage: float = 50,
    dark_year: int = masks.DARK_WATER_YEAR,
    sensors: Sequence[DataFrame] = (),
    weighted: bool = False,
) -> DataFrame:
    """Long records of reservoir means, class areas, points and sensors for the best scenes.

    The pixel table is read twice at most: once for all per-scene figures, once for the points. With `weighted`, pixels
    on the edge of the area count by the share of them that lies inside, else by their centre.
    """
    weight = "weight" if weighted and aoi is not None else None
    area = pixels if aoi is None else spatial.weigh_by_aoi(pixels, aoi, out=weight) if weight else spatial.clip_to_aoi(pixels, aoi)
    summary = reduction.scene_summary(area, names, bins, dark_year, weight)
    carry = [*names, *[f"_areas_{i}{s}" for i in range(len(bins or {})) for s in ("", "_total")]]
    best = screening.best_scene_per_date(summary, max_cloud, min_coverage, carry)
    parts = []
    if points is not None:
        best = cut_lineage(best)
        at_points = reduction.point_means(pixels, points, names)
        parts.append(reshape.point_records(best, at_points, names))
    parts.append(reshape.scene_records(best, names, bins))
    return reshape.union_all([*parts, *sensors])
