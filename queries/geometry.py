"""Areas, points and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.functions import geometry
from limnoscope.operators import reshape, screening, spatial
from queries import standins as s
from queries.registry import fixed, query, sql_fixed
from queries.screening import _INSIDE


@query(
    s.with_views("pixel", "edge", clipped=_INSIDE)
    + "select pixel_id, reservoir_id, scene_date, tile, x, y from clipped"
)
def pixels_in_aoi(spark, sf):
    """Pixels whose centre lies inside the area of their reservoir."""
    inside = spatial.clip_to_aoi(s.pixel(spark, sf), s.aoi(spark, sf))
    return inside.select("pixel_id", "reservoir_id", "scene_date", "tile", "x", "y")


@query(
    s.with_views("poi", "edge")
    + """select p.point, p.reservoir_id, cast(p.x as double) x, cast(p.y as double) y from poi p
    where (select count(*) from edge e where e.reservoir_id = p.reservoir_id
      and (e.y1 > p.y) <> (e.y2 > p.y) and e.x1 + (p.y - e.y1) * (e.x2 - e.x1) * 1.0e0 / (e.y2 - e.y1) > p.x) % 2 = 1"""
)
def points_in_aoi(spark, sf):
    """Points of interest inside the area of their reservoir."""
    points = s.poi(spark, sf).select("point", "reservoir_id", F.col("x").cast("double"), F.col("y").cast("double"))
    return spatial.clip_points(points, s.aoi(spark, sf))


@query(
    s.with_views(
        "edge",
        c="""select reservoir_id, sum((x1+x2)*(x1*y2-x2*y1))/(3e0*sum(x1*y2-x2*y1)) cx,
        sum((y1+y2)*(x1*y2-x2*y1))/(3e0*sum(x1*y2-x2*y1)) cy, min(x1) minx, min(y1) miny, max(x1) maxx, max(y1) maxy from edge group by 1""",
    )
    + f"""select {sql_fixed('avg(cx)')} centre_x, {sql_fixed('avg(cy)')} centre_y, cast(min(minx) as double) minx,
    cast(min(miny) as double) miny, cast(max(maxx) as double) maxx, cast(max(maxy) as double) maxy from c"""
)
def aoi_bounds_centroid(spark, sf):
    """Box around all areas and the mean of their centroids."""
    aoi = s.aoi(spark, sf)
    cx, cy = geometry.ring_centroid(F.col("ring"))
    return aoi.withColumns({"cx": cx, "cy": cy}).agg(
        fixed(F.avg("cx")).alias("centre_x"), fixed(F.avg("cy")).alias("centre_y"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )


@query(
    s.with_views("edge", pixel=s.VIEWS["pixel"], shifted="select * replace (x + 3 as x, y + 10 as y) from pixel", clipped=_INSIDE.replace("from pixel", "from shifted"))
    + "select pixel_id, reservoir_id, cast(x as double) x, cast(y as double) y from clipped"
)
def pixels_in_aoi_offset(spark, sf):
    """Pixels of a grid whose rows lie between the areas' own rows."""
    shifted = s.pixel(spark, sf).withColumns({"x": F.col("x") + 3, "y": F.col("y") + 10})
    return spatial.clip_to_aoi(shifted, s.aoi(spark, sf)).select("pixel_id", "reservoir_id", F.col("x").cast("double"), F.col("y").cast("double"))


@query(s.with_views("poi") + "select reservoir_id as reservoir, point, cast(y as double) lat, cast(x as double) lon from poi")
def poi_nested(spark, sf):
    """Points of each reservoir as a map, taken apart again."""
    points = s.poi(spark, sf).select(
        F.col("reservoir_id").alias("reservoir"), "point", F.col("y").alias("lat"), F.col("x").alias("lon")
    )
    again = points.unionByName(points.withColumns({"lat": F.col("lat") - 1}))
    nested = reshape.nest_points(again).select("reservoir", F.explode("points").alias("point", "place"))
    return nested.select("reservoir", "point", F.col("place.lat").cast("double").alias("lat"), F.col("place.lon").cast("double").alias("lon"))


@query(
    s.with_views("pixel", "poi")
    + """select poi.point, p.reservoir_id, count(*) n_pixels, count(distinct p.x*100000+p.y) n_places from pixel p
    join poi on poi.reservoir_id = p.reservoir_id and (p.x-poi.x)*(p.x-poi.x)+(p.y-poi.y)*(p.y-poi.y) <= 900 group by 1,2"""
)
def pixels_near_points(spark, sf):
    """Pixels within 30 m of each point."""
    near = spatial.pixels_near_points(s.pixel(spark, sf), s.poi(spark, sf))
    places = near.groupBy("point", "reservoir_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy("point", "reservoir_id").agg(
        F.sum("n").alias("n_pixels"), F.count(F.lit(1)).alias("n_places")
    )


# Signed area under each edge inside the pixel's square, as integrals of a clamped line.
def _sql_shares(pixels: str) -> dict[str, str]:
    h = lambda t: f"(least(greatest({t} - low, 0e0), 20e0)**2/2e0 + greatest({t} - low - 20e0, 0e0)*20e0)"
    return {
        "cell": f"select distinct reservoir_id, x, y, x - 10e0 as lo_x, y - 10e0 as low from {pixels}",
        "cut": """select c.*, e.x1, e.y1, (e.y2 - e.y1)*1e0/nullif(e.x2 - e.x1, 0) m,
            least(greatest(e.x1, lo_x), lo_x + 20e0) xa, least(greatest(e.x2, lo_x), lo_x + 20e0) xb
          from cell c join edge e on e.reservoir_id = c.reservoir_id""",
        "ends": "select *, y1 + (xa - x1)*m ya, y1 + (xb - x1)*m yb from cut where xa <> xb",
        "share": f"""select reservoir_id, x, y, least(abs(sum((xb - xa) * case when abs(yb - ya) > 2e-8 then ({h('yb')} - {h('ya')})/(yb - ya)
            else least(greatest((ya + yb)/2e0 - low, 0e0), 20e0) end))/400e0, 1e0) weight from ends group by 1,2,3""",
    }


_WEIGHED = "select p.*, w.weight from {0} p join share w on w.reservoir_id = p.reservoir_id and w.x = p.x and w.y = p.y where w.weight > 1e-9"


def _sql_weighted(value: str, valid: str | None = None) -> str:
    given = f"({value}) is not null" + (f" and {valid}" if valid else "")
    return f"sum(case when {given} then ({value})*weight end)/nullif(sum(case when {given} then weight end), 0)"


@query(
    s.with_views("pixel", "edge", **_sql_shares("pixel"), weighed=_WEIGHED.format("pixel"))
    + f"select pixel_id, reservoir_id, scene_date, tile, {sql_fixed('weight')} weight from weighed"
)
def pixels_weighed(spark, sf):
    """Share of every pixel that lies inside the area of its reservoir."""
    weighed = spatial.weigh_by_aoi(s.pixel(spark, sf), s.aoi(spark, sf))
    return weighed.select("pixel_id", "reservoir_id", "scene_date", "tile", fixed("weight").alias("weight"))


@query(
    s.with_views("edge", pixel=s.VIEWS["pixel"], shifted="select * replace (x + 3e0 as x, y + 10e0 as y) from pixel", **_sql_shares("shifted"), weighed=_WEIGHED.format("shifted"))
    + f"select pixel_id, reservoir_id, {sql_fixed('weight')} weight from weighed"
)
def pixels_weighed_offset(spark, sf):
    """Shares of the pixels of a grid that lies beside the areas' own."""
    shifted = s.pixel(spark, sf).withColumns({"x": F.col("x") + 3, "y": F.col("y") + 10})
    weighed = spatial.weigh_by_aoi(shifted, s.aoi(spark, sf))
    return weighed.select("pixel_id", "reservoir_id", fixed("weight").alias("weight"))


# Granules are the boxes of a scene's pixels in blocks of 180 m; their footprints are rhombs, so corners of the boxes lie outside.
_GRANULE = """select reservoir_id, scene_date, tile, cast(floor(x/180) as int) bx, cast(floor(y/180) as int) "by",
    min(x) - 10 minx, min(y) - 10 miny, max(x) + 10 maxx, max(y) + 10 maxy, min(cloud_meta) cloud_meta from pixel group by 1,2,3,4,5"""
_CORNERS = (("minx", "my"), ("mx", "maxy"), ("maxx", "my"), ("mx", "miny"))


def _granules(spark, sf):
    boxes = s.pixel(spark, sf).groupBy(
        "reservoir_id", "scene_date", "tile", F.floor(F.col("x") / 180).cast("int").alias("bx"), F.floor(F.col("y") / 180).cast("int").alias("by")
    ).agg(
        (F.min("x") - 10).alias("minx"), (F.min("y") - 10).alias("miny"), (F.max("x") + 10).alias("maxx"), (F.max("y") + 10).alias("maxy"),
        F.min("cloud_meta").alias("cloud_meta"),
    )
    middle = {"mx": (F.col("minx") + F.col("maxx")) / 2, "my": (F.col("miny") + F.col("maxy")) / 2}
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(*[corner(x, y) for x, y in (*_CORNERS, _CORNERS[0])])
    return boxes.withColumns(middle).withColumn("ring", ring).drop("mx", "my")


def _sql_meets() -> str:
    """Edges that cross or touch, as signs of turns."""
    turn = lambda e, x, y: f"sign(({e}.x2-{e}.x1)*({y}-{e}.y1)-({e}.y2-{e}.y1)*({x}-{e}.x1))"
    on = lambda e, x, y: f"({turn(e, x, y)} = 0 and {x} between least({e}.x1,{e}.x2) and greatest({e}.x1,{e}.x2) and {y} between least({e}.y1,{e}.y2) and greatest({e}.y1,{e}.y2))"
    ends = lambda e: [(f"{e}.x1", f"{e}.y1"), (f"{e}.x2", f"{e}.y2")]
    (f1, f2), (e1, e2) = ends("f"), ends("e")
    crossing = f"({turn('e', *f1)}*{turn('e', *f2)} < 0 and {turn('f', *e1)}*{turn('f', *e2)} < 0)"
    return " or ".join([crossing, *[on("e", *p) for p in (f1, f2)], *[on("f", *p) for p in (e1, e2)]])


def _sql_holds(edges: str, same: str, x: str, y: str) -> str:
    return f"(select count(*) from {edges} q where {same} and (q.y1 > {y}) <> (q.y2 > {y}) and q.x1 + ({y} - q.y1)*(q.x2 - q.x1)*1e0/(q.y2 - q.y1) > {x}) % 2 = 1"


_RHOMB = " union all ".join(
    f"select g, reservoir_id, {a[0]} x1, {a[1]} y1, {b[0]} x2, {b[1]} y2 from placed" for a, b in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]))
)


@query(
    s.with_views(
        "pixel", "edge", granule=_GRANULE,
        placed="select *, row_number() over () g, (minx + maxx)/2e0 mx, (miny + maxy)/2e0 my from granule",
        rhomb=_RHOMB,
        box="select reservoir_id, min(x1) ax1, min(y1) ay1, max(x1) ax2, max(y1) ay2 from edge group by 1",
        boxed="select p.* from placed p join box b on b.reservoir_id = p.reservoir_id and minx <= ax2 and maxx >= ax1 and miny <= ay2 and maxy >= ay1",
        crossed=f"select distinct f.g from rhomb f join edge e on e.reservoir_id = f.reservoir_id where {_sql_meets()}",
        corner="select reservoir_id, min(x1) cx, min_by(y1, x1) cy from edge group by 1",
        held=f"""select g from placed p where {_sql_holds('edge', 'q.reservoir_id = p.reservoir_id', 'p.mx', 'p.maxy')}
          union select p.g from placed p join corner c using (reservoir_id) where {_sql_holds('rhomb', 'q.g = p.g', 'c.cx', 'c.cy')}""",
    )
    + f"""select reservoir_id, scene_date, count(*) n_boxes, count_if(g in (select g from crossed union select g from held))::bigint n_footprints
    from boxed where scene_date >= date '1996-01-01' and scene_date < date '1997-01-01' group by 1,2"""
)
def footprints_in_aoi(spark, sf):
    """Granules whose box meets the area's box, and those whose footprint meets the area itself."""
    granules, areas = _granules(spark, sf), s.aoi(spark, sf)
    boxed = screening.scene_search(granules, "1996-01-01", "1997-01-01", boxes=areas)
    exact = screening.scene_search(granules, "1996-01-01", "1997-01-01", boxes=areas, footprint="ring")
    both = boxed.groupBy("reservoir_id", "scene_date").agg(F.count(F.lit(1)).alias("n_boxes"))
    met = exact.groupBy("reservoir_id", "scene_date").agg(F.count(F.lit(1)).alias("n_footprints"))
    return both.join(met, ["reservoir_id", "scene_date"], "left").select(
        "reservoir_id", "scene_date", "n_boxes", F.coalesce("n_footprints", F.lit(0).cast("long")).alias("n_footprints")
    )
