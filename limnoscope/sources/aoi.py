"""Areas of interest from GeoJSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.operators.spatial import with_bounds
from limnoscope.schemas import GEOJSON


def _as_ring(positions: Column) -> Column:
    return F.transform(positions, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def aoi_from_geojson(texts: DataFrame, column: str = "geojson", name_property: str = "NOMBRE") -> DataFrame:
    """(name, ring, box) of every feature: first part of a multipolygon, outer ring only."""
    parsed = texts.withColumn("_f", F.explode(F.from_json(F.col(column), GEOJSON)["features"]))
    geometry = F.col("_f.geometry")
    polygon = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    multipolygon = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    outer = F.when(geometry["type"] == "MultiPolygon", multipolygon[0][0]).when(
        geometry["type"] == "Polygon", polygon[0]
    )
    others = [c for c in texts.columns if c != column]
    rings = parsed.select(
        *others, F.element_at(F.col("_f.properties"), name_property).alias("name"), _as_ring(outer).alias("ring")
    )
    return with_bounds(rings.where(F.size("ring") > 3))


def aoi_from_vertices(vertices: DataFrame, order: str = "vertex_no") -> DataFrame:
    """Areas from one row per vertex; a ring holds as many entries as the polygon has corners."""
    gathered = vertices.groupBy("reservoir_id", "name").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("v")
    )
    ring = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return with_bounds(gathered.select("reservoir_id", "name", ring.alias("ring")))
