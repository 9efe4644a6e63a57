"""Scene screening: cloud and coverage per scene, thresholds, best scene per date.

All per-scene figures come from one aggregation of the pixel table on the scene key. Partial
aggregation leaves one row per scene and input task, so a reservoir that holds a third of all pixels
shuffles no more than a small one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions import masks
from limnoscope.functions.numeric import percent
from limnoscope.schemas import SCENE_KEYS

# Weights of the class-based and the probability-based cloud share.
CLASS_WEIGHT, PROBABILITY_WEIGHT = 0.95, 0.05


def weighted_mean(value: Column, weight: str | None = None) -> Column:
    """Mean of the valid values; with `weight`, a pixel counts by the share of it that the column names."""
    if weight is None:
        return F.avg(value)
    share = F.when(value.isNotNull(), F.col(weight))
    return F.try_divide(F.sum(value * share), F.sum(share))


def screening_aggregates(weight: str | None = None) -> list[Column]:
    """Aggregates every scene row starts with; `finish_screening` turns them into percents."""
    scl, probability = F.col("scl"), F.col("cldprb")
    valid = masks.in_screening(scl)
    flag = lambda c: F.when(valid, c.cast("double"))
    area = F.col("area_m2") if weight is None else F.col("area_m2") * F.col(weight)
    covered = F.col("b4").isNotNull()
    counted = [F.count("b4"), F.count(F.lit(1))] if weight is None else [F.coalesce(F.sum(F.when(covered, F.col(weight))), F.lit(0.0)), F.sum(weight)]
    return [
        F.min("scene_ts").alias("scene_ts"),
        F.min("cloud_meta").alias("cloud_meta"),
        F.count(F.lit(1)).alias("n_pixels"),
        weighted_mean(flag(masks.is_cloud(scl)), weight).alias("_by_class"),
        weighted_mean(flag(masks.is_probable_cloud(probability)), weight).alias("_by_probability"),
        counted[0].alias("_covered"),
        counted[1].alias("_whole"),
        F.sum(area).alias("_area"),
        F.sum(F.when(covered, area)).alias("_covered_area"),
    ]


def finish_screening(scenes: DataFrame) -> DataFrame:
    by_class, by_probability = F.col("_by_class"), F.col("_by_probability")
    return scenes.withColumns(
        {
            # One share stands in when the other is missing.
            "cloud_pct": F.coalesce(
                100.0 * (CLASS_WEIGHT * by_class + PROBABILITY_WEIGHT * by_probability),
                100.0 * by_class,
                100.0 * by_probability,
            ),
            "coverage_count_pct": percent(F.col("_covered"), F.col("_whole")),
            "coverage_area_pct": percent(F.col("_covered_area"), F.col("_area")),
        }
    ).drop("_by_class", "_by_probability", "_covered", "_whole", "_area", "_covered_area")


def scene_statistics(
    pixels: DataFrame, keys: Sequence[str] = SCENE_KEYS, extra: Sequence[Column] = (), weight: str | None = None
) -> DataFrame:
    """One row per scene: time, pixel count, cloud and coverage percents, and any `extra` aggregates.

    With `weight`, shares are those of the area that the column gives, as `spatial.weigh_by_aoi` finds it.
    """
    return finish_screening(pixels.groupBy(*keys).agg(*screening_aggregates(weight), *extra))


def passes(max_cloud: float, min_coverage: float, coverage: str = "coverage_count_pct") -> Column:
    """Threshold test; a limit of 100 lets any computable cloud share pass."""
    cloud = F.col("cloud_pct")
    cloud_ok = cloud.isNotNull() if max_cloud == 100 else (cloud <= float(max_cloud))
    return cloud_ok & (F.col(coverage) >= float(min_coverage))


def valid_dates(scenes: DataFrame, max_cloud: float, min_coverage: float) -> DataFrame:
    """Dates with at least one passing scene, with the cloud share of its first passing scene."""
    first = F.min_by("cloud_pct", F.struct("scene_ts", "tile"))
    return (
        scenes.where(passes(max_cloud, min_coverage))
        .groupBy("reservoir_id", "scene_date")
        .agg(first.alias("cloud_pct"))
    )


def best_scene_per_date(
    scenes: DataFrame, max_cloud: float, min_coverage: float, carry: Sequence[str] = ()
) -> DataFrame:
    """Least cloudy passing scene of each reservoir and date; the earliest on a tie."""
    order = ["cloud_pct", "scene_ts", "tile"]
    rest = [c for c in ("coverage_count_pct", "n_pixels", *carry) if c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return (
        scenes.where(passes(max_cloud, min_coverage))
        .groupBy("reservoir_id", "scene_date")
        .agg(best)
        .select("reservoir_id", "scene_date", "_best.*")
    )


def cloud_of_dates(dates: DataFrame, listed: DataFrame, day: str = "date") -> DataFrame:
    """Cloud share of asked dates from a stored list of valid dates; unknown dates stay with NULL."""
    known = listed.groupBy("reservoir_id", day).agg(F.min("cloud_pct").alias("cloud_pct"))
    return dates.join(known, ["reservoir_id", day], "left")


def scene_search(
    scenes: DataFrame,
    start: str,
    end: str,
    max_cloud_meta: float | None = None,
    boxes: DataFrame | None = None,
    inclusive_end: bool = False,
    footprint: str | None = None,
) -> DataFrame:
    """Scenes in a date range, under a metadata cloud limit, overlapping their reservoir's box.

    With `footprint`, the scenes' ring column, the two polygons themselves must share a point; `boxes` then also carries
    `ring`. The box test comes first, so few pairs get that far. A scene that meets several areas stays one row.
    """
    from limnoscope.functions.geometry import boxes_overlap, rings_meet
    from limnoscope.functions.temporal import day_range
    from limnoscope.operators.sizing import lookup_join

    found = scenes.where(day_range(F.col("scene_date"), start, end, inclusive_end))
    if max_cloud_meta is not None:
        found = found.where(F.col("cloud_meta") <= max_cloud_meta)
    if boxes is not None:
        box = boxes.select("reservoir_id", *[F.col(c).alias(f"aoi_{c}") for c in ("minx", "miny", "maxx", "maxy", *(["ring"] if footprint else []))])
        meets = boxes_overlap("", "aoi_")
        if footprint is not None:
            meets = meets & rings_meet(F.col(footprint), F.col("aoi_ring"))
            return lookup_join(found, box, ["reservoir_id"], ["scene_date", "tile"], meets, "left_semi")
        found = lookup_join(found, box, ["reservoir_id"], ["scene_date", "tile"], meets).drop("aoi_minx", "aoi_miny", "aoi_maxx", "aoi_maxy")
    return found


def scenes_of(pixels: DataFrame, keys: Sequence[str] = SCENE_KEYS) -> DataFrame:
    """Scene table of a pixel table: time, metadata cloud and bounding box."""
    return pixels.groupBy(*keys).agg(
        F.min("scene_ts").alias("scene_ts"), F.min("cloud_meta").alias("cloud_meta"),
        F.min("x").alias("minx"), F.min("y").alias("miny"),
        F.max("x").alias("maxx"), F.max("y").alias("maxy"),
    )
