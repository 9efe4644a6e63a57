"""Long and wide result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions.geometry import hectares
from limnoscope.functions.numeric import percent
from limnoscope.operators.reduction import DISTRIBUTED, DISTRIBUTION, ESTIMATED, MEASURED, RESERVOIR_MEAN
from limnoscope.schemas import SCENE_KEYS

RECORD = ("reservoir_id", "location", "ts", "kind", "measure", "value")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def indices_to_rows(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, index_name, value); NULL values stay."""
    return wide.unpivot([F.col(k) for k in keys], [F.col(f"`{n}`") for n in names], "index_name", "value")


def _records(entries: list[Column]) -> Column:
    return F.inline(F.array(*entries))


def _entry(location: Column, kind: str, measure: Column, value: Column) -> Column:
    return F.struct(
        location.alias("location"), F.lit(kind).alias("kind"), measure.alias("measure"),
        value.cast("double").alias("value"),
    )


def _scene_entries(names: Sequence[str], bins: Mapping[str, Sequence[float]] | None) -> list[Column]:
    entries = [_entry(F.lit(RESERVOIR_MEAN), ESTIMATED, F.lit(n), F.col(f"`{n}`")) for n in names]
    for i, (name, edges) in enumerate((bins or {}).items()):
        whole = F.col(f"_areas_{i}_total")
        for k, (lo, up) in enumerate(zip(edges, edges[1:]), start=1):
            label = f"{name} {float(lo)}–{float(up)}"
            part = F.element_at(f"_areas_{i}", k)
            entries.append(_entry(F.lit(DISTRIBUTION), DISTRIBUTED, F.lit(f"{label} area_ha"), hectares(part)))
            entries.append(_entry(F.lit(DISTRIBUTION), DISTRIBUTED, F.lit(f"{label} percent"), percent(part, whole)))
    return entries


def scene_records(
    best: DataFrame, names: Sequence[str], bins: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """Long records of the chosen scenes: means, and area and share per class."""
    rows = best.select("reservoir_id", F.col("scene_ts").alias("ts"), _records(_scene_entries(names, bins)))
    return rows.where(F.col("value").isNotNull()).select(*RECORD)


def point_records(best: DataFrame, points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long records of the points inside the chosen scenes."""
    chosen = best.select(*SCENE_KEYS, F.col("scene_ts").alias("ts"))
    entries = [_entry(F.col("point"), ESTIMATED, F.lit(n), F.col(f"`{n}`")) for n in names]
    rows = points.join(chosen, list(SCENE_KEYS)).select("reservoir_id", "ts", _records(entries))
    return rows.where(F.col("value").isNotNull()).select(*RECORD)


def sensor_records(sensor: DataFrame, location: Column, measures: Mapping[str, str]) -> DataFrame:
    """Long records of measured values: `measures` maps sensor columns to measure names."""
    entries = [_entry(location, MEASURED, F.lit(label), F.col(c)) for c, label in measures.items()]
    rows = sensor.select("reservoir_id", "ts", _records(entries))
    return rows.where(F.col("value").isNotNull()).select(*RECORD)


def to_wide(records: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per (reservoir, location, time, kind); the largest value where several share a cell."""
    wide = (
        records.where(F.col("measure").isin(*measures))
        .groupBy("reservoir_id", "location", "ts", "kind")
        .agg(*[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in measures])
    )
    return wide


def collapse_means(table: DataFrame, keys: Sequence[str], values: Sequence[str], location: str = "location") -> DataFrame:
    """Merge the sparse rows of the reservoir mean; other rows stay as they are."""
    is_mean = F.col(location) == RESERVOIR_MEAN
    merged = table.where(is_mean).groupBy(*keys).agg(*[F.max(F.col(f"`{v}`")).alias(v) for v in values])
    others = table.where(~F.coalesce(is_mean, F.lit(False))).select(*keys, *[F.col(f"`{v}`") for v in values])
    return merged.unionByName(others, allowMissingColumns=True)


def with_reading_time(table: DataFrame, times: Sequence[str], out: str = "ts") -> DataFrame:
    """One time per row, from the first of the named columns that holds a readable one; rows without any are left out."""
    known = [F.col(f"`{t}`").try_cast("timestamp") for t in times if t in table.columns]
    if not known:
        raise ValueError(f"none of the time columns {list(times)} is there")
    rest = [F.col(f"`{c}`") for c in table.columns if c not in times]
    return table.select(F.coalesce(*known).alias(out), *rest).where(F.col(out).isNotNull())


def split_means(table: DataFrame, location: str = "location") -> tuple[DataFrame, DataFrame]:
    """(reservoir means, points)."""
    is_mean = F.col(location) == RESERVOIR_MEAN
    return table.where(is_mean), table.where(~is_mean)


def nest_points(points: DataFrame, reservoir: str = "reservoir", order: str | None = None) -> DataFrame:
    """`reservoir -> {point: (lat, lon)}`; a reservoir has a handful of points.

    Of points with one name the last by `order` stays, or without an order the northernmost, then easternmost.
    """
    place = F.struct("lat", "lon")
    last = F.max(place) if order is None else F.max_by(place, F.col(order))
    single = points.groupBy(reservoir, "point").agg(last.alias("place"))
    return single.groupBy(reservoir).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("point", "place")))).alias("points")
    )
