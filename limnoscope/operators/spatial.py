"""Pixels inside areas of interest and around points.

Pixels lie on a regular grid, so a polygon is turned once into spans: for every grid row the x ranges
inside the ring. A pixel then needs one hash lookup on (reservoir, row) and a range test that stays in
generated code, however many vertices the ring has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions import geometry
from limnoscope.operators.sizing import BROADCAST_ROWS, lookup_join

PIXEL_SIZE = 20.0
POINT_RADIUS = 30.0
# Smaller shares of a pixel are rounding.
LEAST_SHARE = 1e-9


def with_bounds(aoi: DataFrame) -> DataFrame:
    return aoi.withColumns(geometry.ring_bounds(F.col("ring")))


def grid_row(y: Column, size: float, origin: float) -> Column:
    return F.round((y - F.lit(float(origin))) / F.lit(float(size))).cast("long")


def aoi_spans(aoi: DataFrame, size: float = PIXEL_SIZE, origin: float = 0.0) -> DataFrame:
    """(reservoir, grid row, x from, x to) for every run of pixel centres inside a ring."""
    bounds = geometry.ring_bounds(F.col("ring"))
    first = F.floor((bounds["miny"] - F.lit(float(origin))) / F.lit(float(size)))
    last = F.ceil((bounds["maxy"] - F.lit(float(origin))) / F.lit(float(size)))
    rows = aoi.select("reservoir_id", "ring", F.explode(F.sequence(first, last)).alias("grid_row"))
    row_y = F.col("grid_row") * F.lit(float(size)) + F.lit(float(origin))
    crossings = rows.select("reservoir_id", "grid_row", geometry.row_crossings(F.col("ring"), row_y).alias("c"))
    spans = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("c") / 2).cast("int")),
        lambda i: F.struct(
            F.element_at("c", i * 2 - 1).alias("x_from"), F.element_at("c", i * 2).alias("x_to")
        ),
    )
    return crossings.where(F.size("c") > 1).select("reservoir_id", "grid_row", F.inline(spans))


def clip_to_aoi(
    pixels: DataFrame, aoi: DataFrame, size: float = PIXEL_SIZE, origin: float = 0.0, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Pixels whose centre lies inside a polygon of their reservoir, each once.

    Centres on the grid rows meet the rows' spans; centres beside them are tested against the ring itself.
    """
    rows = pixels.withColumn("grid_row", grid_row(F.col("y"), size, origin))
    on_grid = F.abs(F.col("y") - (F.col("grid_row") * F.lit(float(size)) + F.lit(float(origin)))) < 1e-9 * size
    inside = (F.col("x") >= F.col("x_from")) & (F.col("x") < F.col("x_to"))
    spans = aoi_spans(aoi, size, origin)
    near = lookup_join(rows.where(on_grid), spans, ["reservoir_id", "grid_row"], ["pixel_id"], inside, "left_semi", max_rows)
    far = clip_points(rows.where(~on_grid).select(*pixels.columns), aoi, max_rows)
    return near.select(*pixels.columns).unionByName(far)


def aoi_cover(aoi: DataFrame, size: float = PIXEL_SIZE, origin: float = 0.0) -> DataFrame:
    """(reservoir_id, grid_row, runs): the runs of pixels that an area covers, with the share of each pixel inside.

    A ring's edges touch few pixels of a row; those are runs of one pixel with their exact share. The pixels between two
    of them lie wholly inside or outside, so one of them decides for all. One row per reservoir and grid row, whatever
    the number of rings and vertices.
    """
    unit, start = F.lit(float(size)), F.lit(float(origin))
    bounds = geometry.ring_bounds(F.col("ring"))
    number = lambda v: F.floor((v - start) / unit + 0.5)  # the pixel that holds a coordinate
    centre = lambda k: k * unit + start
    rows = aoi.select("reservoir_id", "ring", F.explode(F.sequence(number(bounds["miny"]), number(bounds["maxy"]))).alias("grid_row"))
    rows = rows.withColumn("row_y", centre(F.col("grid_row")))
    low, high = F.col("row_y") - size / 2.0, F.col("row_y") + size / 2.0

    def columns(e: Column) -> Column:
        at = lambda y, x: F.when(e["y1"] == e["y2"], x).otherwise(
            e["x1"] + (F.least(F.greatest(y, low), high) - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        )
        a, b = number(at(e["y1"], e["x1"])), number(at(e["y2"], e["x2"]))
        return F.sequence(F.least(a, b), F.greatest(a, b))

    in_row = lambda e: (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low)
    touched = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(geometry.ring_edges(F.col("ring")), in_row), columns))))
    cut = rows.withColumn("touched", touched)
    run = lambda a, b, share: F.struct(a.alias("first"), b.alias("last"), share.alias("share"))
    edge_runs = F.transform("touched", lambda c: run(c, c, geometry.covered_share(F.col("ring"), centre(c), F.col("row_y"), size)))
    gaps = F.transform(
        F.sequence(F.lit(1), F.size("touched") - 1),
        lambda i: run(F.element_at("touched", i) + 1, F.element_at("touched", i + 1) - 1, F.lit(1.0)),
    )
    inner = F.filter(gaps, lambda g: (g["first"] <= g["last"]) & geometry.contains(F.col("ring"), centre(g["first"]), F.col("row_y")))
    runs = F.when(F.size("touched") > 1, F.concat(edge_runs, inner)).otherwise(edge_runs)
    kept = cut.select("reservoir_id", "grid_row", F.filter(runs, lambda r: r["share"] > LEAST_SHARE).alias("runs")).where(F.size("runs") > 0)
    return kept.groupBy("reservoir_id", "grid_row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def weigh_by_aoi(
    pixels: DataFrame, aoi: DataFrame, size: float = PIXEL_SIZE, origin: float = 0.0, max_rows: int = BROADCAST_ROWS, out: str = "weight"
) -> DataFrame:
    """Pixels that an area of their reservoir covers at least in part, each once, with the covered share.

    Pixels of the grid meet the runs of their row; a pixel beside the grid is measured against the rings themselves.
    Shares of several rings of one reservoir add up to 1 at most.
    """
    cell = lambda c: (F.col(c) - F.lit(float(origin))) / F.lit(float(size))
    rows = pixels.withColumns({"grid_row": F.round(cell("y")).cast("long"), "_column": F.round(cell("x")).cast("long")})
    on_grid = (F.abs(cell("y") - F.col("grid_row")) < 1e-9) & (F.abs(cell("x") - F.col("_column")) < 1e-9)
    here = lambda r: (r["first"] <= F.col("_column")) & (F.col("_column") <= r["last"])
    near = lookup_join(rows.where(on_grid), aoi_cover(aoi, size, origin), ["reservoir_id", "grid_row"], ["pixel_id"], max_rows=max_rows)
    added = F.aggregate(F.filter("runs", here), F.lit(0.0), lambda total, r: total + r["share"])
    near = near.withColumn(out, F.least(added, F.lit(1.0)))
    # One row per reservoir, so a pixel stays one row however many rings there are.
    rings = aoi.groupBy("reservoir_id").agg(F.collect_list("ring").alias("_rings"))
    far = lookup_join(rows.where(~on_grid), rings, ["reservoir_id"], ["pixel_id"], max_rows=max_rows)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    measured = F.aggregate("_rings", F.lit(0.0), lambda total, r: total + geometry.covered_share(r, x, y, size))
    far = far.withColumn(out, F.least(measured, F.lit(1.0)))
    return near.select(*pixels.columns, out).unionByName(far.select(*pixels.columns, out)).where(F.col(out) > LEAST_SHARE)


def clip_points(points: DataFrame, aoi: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Points off any grid: box test, then the even-odd test against the ring."""
    box = with_bounds(aoi)
    inside = geometry.inside_box(F.col("x"), F.col("y")) & geometry.contains(
        F.col("ring"), F.col("x"), F.col("y")
    )
    joined = lookup_join(points, box, ["reservoir_id"], ["x", "y"], inside, "left_semi", max_rows)
    return joined.select(*points.columns)


def pixels_near_points(
    pixels: DataFrame,
    points: DataFrame,
    radius: float = POINT_RADIUS,
    geographic: bool = False,
    cell: float | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pixel-point pairs within `radius`, joined on a grid cell.

    Each point is listed under the cells its circle can reach, each pixel under its own cell only, so
    a pair is met once. With `geographic` the coordinates are lon/lat degrees and the radius metres.
    """
    if geographic:
        # Degrees of latitude; a degree of longitude is shorter by the cosine of the latitude.
        cell = cell or radius / 50_000.0
        reach_y = F.lit(radius / 110_000.0)
        reach_x = reach_y / F.greatest(F.cos(F.radians("point_y")), F.lit(0.01))
    else:
        cell = cell or 2 * radius
        reach_x = reach_y = F.lit(float(radius))
    number = lambda c: F.floor(c / F.lit(float(cell)))
    span = lambda c, reach: F.explode(F.sequence(number(c - reach), number(c + reach)))
    listed = (
        points.select(
            "reservoir_id", "point", F.col("x").cast("double").alias("point_x"), F.col("y").cast("double").alias("point_y")
        )
        .withColumn("cell_x", span(F.col("point_x"), reach_x))
        .withColumn("cell_y", span(F.col("point_y"), reach_y))
    )
    placed = pixels.withColumns({"cell_x": number(F.col("x")), "cell_y": number(F.col("y"))})
    if geographic:
        near = geometry.haversine_m(F.col("x"), F.col("y"), F.col("point_x"), F.col("point_y")) <= radius
    else:
        near = geometry.within_planar(F.col("x"), F.col("y"), F.col("point_x"), F.col("point_y"), radius)
    joined = lookup_join(
        placed, listed, ["reservoir_id", "cell_x", "cell_y"], ["pixel_id"], near, max_rows=max_rows
    )
    return joined.drop("cell_x", "cell_y", "point_x", "point_y")


def total_bounds(aoi: DataFrame) -> DataFrame:
    """Box around all polygons."""
    return with_bounds(aoi).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )


def mean_centroid(aoi: DataFrame) -> DataFrame:
    cx, cy = geometry.ring_centroid(F.col("ring"))
    return aoi.select(cx.alias("cx"), cy.alias("cy")).agg(
        F.avg("cx").alias("centre_x"), F.avg("cy").alias("centre_y")
    )
