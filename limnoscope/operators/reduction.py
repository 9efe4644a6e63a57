"""From pixels to reservoir means, point means and areas by class.

`scene_summary` does screening, means and class areas in one aggregation, so the pixel table is read
once; choosing scenes afterwards works on one row per scene. Filtering pixels by chosen scenes first
would need a second scan and a join of the whole pixel table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions import masks, spectral
from limnoscope.functions.geometry import hectares
from limnoscope.functions.numeric import percent
from limnoscope.operators import screening, spatial
from limnoscope.schemas import SCENE_KEYS

RESERVOIR_MEAN = "Media_Embalse"
DISTRIBUTION = "Distribucion_Embalse"
ESTIMATED, DISTRIBUTED, MEASURED = "Valor Estimado", "Distribucion", "Valor Real"


def _water(dark_year: int) -> Column:
    return masks.is_water(F.col("scl"), F.col("scene_date"), dark_year)


def with_water_values(
    pixels: DataFrame, names: Sequence[str], dark_year: int = masks.DARK_WATER_YEAR
) -> tuple[DataFrame, dict[str, str]]:
    """Each index over water as a column of its own, and the column names.

    A projection below the aggregation computes an index once, however many aggregates read it.
    """
    spectral.check_bands(pixels, names)
    columns = {n: f"_w{i}" for i, n in enumerate(dict.fromkeys(names))}
    water = _water(dark_year)
    return pixels.withColumns({c: masks.masked(spectral.index_column(n), water) for n, c in columns.items()}), columns


def aoi_means(names: Sequence[str], weight: str | None = None) -> list[Column]:
    """Means over the whole area, without water mask."""
    return [screening.weighted_mean(spectral.index_column(n), weight).alias(n) for n in names]


def class_areas(value: str, edges: Sequence[float], out: str, weight: str | None = None) -> list[Column]:
    """Array of areas per class `[low, up)` of a value column, and the area of all its valid pixels."""
    area = F.col("area_m2") if weight is None else F.col("area_m2") * F.col(weight)
    per_class = [
        F.coalesce(F.sum(F.when((F.col(value) >= float(lo)) & (F.col(value) < float(up)), area)), F.lit(0.0))
        for lo, up in zip(edges, edges[1:])
    ]
    whole = F.coalesce(F.sum(F.when(F.col(value).isNotNull(), area)), F.lit(0.0))
    return [F.array(*per_class).alias(out), whole.alias(f"{out}_total")]


def scene_summary(
    pixels: DataFrame,
    names: Sequence[str],
    bins: Mapping[str, Sequence[float]] | None = None,
    dark_year: int = masks.DARK_WATER_YEAR,
    weight: str | None = None,
) -> DataFrame:
    """Screening figures, water means and class areas of every scene from a single scan.

    With `weight` (see `spatial.weigh_by_aoi`), pixels on the shore count by the share that lies in the area.
    """
    valued, columns = with_water_values(pixels, [*names, *(bins or {})], dark_year)
    extra = [screening.weighted_mean(F.col(columns[n]), weight).alias(n) for n in names]
    for i, (name, edges) in enumerate((bins or {}).items()):
        extra += class_areas(columns[name], edges, f"_areas_{i}", weight)
    return screening.scene_statistics(valued, extra=extra, weight=weight)


def reservoir_daily_means(
    pixels: DataFrame,
    names: Sequence[str],
    max_cloud: float = 60,
    min_coverage: float = 50,
    dark_year: int = masks.DARK_WATER_YEAR,
    weight: str | None = None,
) -> DataFrame:
    """Mean of each index over water for the best scene of each reservoir and date."""
    summary = scene_summary(pixels, names, dark_year=dark_year, weight=weight)
    best = screening.best_scene_per_date(summary, max_cloud, min_coverage, carry=names)
    return best.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def point_means(
    pixels: DataFrame,
    points: DataFrame,
    names: Sequence[str],
    radius: float = spatial.POINT_RADIUS,
    geographic: bool = False,
) -> DataFrame:
    """Mean of each index within `radius` of each point, per scene; rows with no value are left out."""
    spectral.check_bands(pixels, names)
    near = spatial.pixels_near_points(pixels, points, radius, geographic)
    means = near.groupBy(*SCENE_KEYS, "point").agg(*aoi_means(names))
    return means.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def class_rows(areas: str, edges: Sequence[float]) -> Column:
    """Rows (class_no, low, up, range, area_ha, percent) of one scene's class areas."""
    entries = []
    for i, (lo, up) in enumerate(zip(edges, edges[1:])):
        part = F.element_at(areas, i + 1)
        entries.append(
            F.struct(
                F.lit(i + 1).alias("class_no"),
                F.lit(float(lo)).alias("low"),
                F.lit(float(up)).alias("up"),
                F.lit(f"{float(lo)}–{float(up)}").alias("range"),
                hectares(part).alias("area_ha"),
                percent(part, F.col(f"{areas}_total")).alias("percent"),
            )
        )
    return F.inline(F.array(*entries))


def area_by_class(
    pixels: DataFrame,
    name: str,
    edges: Sequence[float],
    keys: Sequence[str] = SCENE_KEYS,
    dark_year: int = masks.DARK_WATER_YEAR,
    weight: str | None = None,
) -> DataFrame:
    """Area and share of each class per scene; empty classes stay, values outside all classes count in the total."""
    valued, columns = with_water_values(pixels, [name], dark_year)
    summed = valued.groupBy(*keys).agg(*class_areas(columns[name], edges, "_areas", weight))
    return summed.select(*keys, class_rows("_areas", edges))
