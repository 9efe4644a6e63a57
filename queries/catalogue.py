"""Reservoir and index look-ups, precomputed dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.functions import masks
from limnoscope.functions.numeric import class_edges, class_label
from limnoscope.functions.temporal import from_epoch_millis
from limnoscope.functions.text import calibrated_band_name
from limnoscope.operators import dimensions, reshape, screening
from limnoscope.session import scratch_path
from limnoscope.sources import files
from limnoscope.sources.aoi import aoi_from_geojson
from queries import standins as s
from queries.registry import fixed, query, sql_fixed, sql_stamp, stamp

# Aliases and their reservoir keys spread over the regions, so that names with accents are looked up too.
_NAMES = "case r_regionkey when 0 then 'El Val' when 1 then 'Bellús' when 2 then 'VAL' else r_name end"
_KEY = "case lower(strip_accents(name)) when 'el val' then 'val' when 'val' then 'val' when 'bellus' then 'bellus' end"


def _reservoirs(spark, sf):
    return s.table(spark, sf, "region").selectExpr("r_regionkey as reservoir_id", f"{_NAMES} as name")


@query(
    f"""with r as (select r_regionkey reservoir_id, {_NAMES} as name from region)
    select reservoir_id, name, lower(replace(name, ' ', '_')) name_key, {_KEY} reservoir_key,
      lower(replace(name, ' ', '_')) = 'el_val' as wanted from r where name is not null"""
)
def reservoir_lookup(spark, sf):
    """Normalised names, alias keys and the look-up of one name."""
    from limnoscope.functions.text import name_key

    named = dimensions.with_reservoir_key(_reservoirs(spark, sf).where(F.col("name").isNotNull()))
    wanted = dimensions.find_reservoir(named, "el val").select("reservoir_id", F.lit(True).alias("_w"))
    return named.join(wanted, "reservoir_id", "left").select(
        "reservoir_id", "name", name_key(F.col("name")).alias("name_key"), "reservoir_key",
        F.coalesce("_w", F.lit(False)).alias("wanted"),
    )


@query("select distinct n_name as name from nation where n_name is not null order by 1")
def reservoir_names(spark, sf):
    """Distinct names in order."""
    return dimensions.reservoir_names(s.table(spark, sf, "nation").withColumnRenamed("n_name", "name"))


_INDEX_ROWS = ",".join(
    f"('{n}','{f}','{k}')"
    for n, f, k in [
        ("MCI", "chlorophyll", "*"), ("PCI_B5/B4", "phycocyanin", "*"), ("NDCI_ind", "chlorophyll", "*"),
        ("UV_PC_Gral_cal", "phycocyanin", "*"), ("PC_Val_cal", "phycocyanin", "val"),
        ("Chla_Val_cal", "chlorophyll", "val"), ("PC_Bellus_cal", "phycocyanin", "bellus"),
        ("Chla_Bellus_cal", "chlorophyll", "bellus"), ("Calibrated_x", "calibrated", "*"),
    ]
)


@query(
    f"""with r as (select r_regionkey reservoir_id, {_NAMES} as name from region),
    k as (select reservoir_id, name, {_KEY} reservoir_key from r)
    select reservoir_id, name, i.index_name, i.family from k
    join (values {_INDEX_ROWS}) i(index_name, family, scope) on i.scope = '*' or i.scope = k.reservoir_key"""
)
def index_catalogue(spark, sf):
    """Indices offered for each reservoir, with their family."""
    allowed = dimensions.allowed_indices(_reservoirs(spark, sf), calibrated_band="Calibrated_x")
    return allowed.select("reservoir_id", "name", "index_name", "family")


_SCL_ROWS = ",".join(f"({c},'{es}','{en}')" for c, (es, en) in masks.SCL_LABELS.items())


@query(
    s.with_views("pixel")
    + f"""select d.code, d.label_es, d.label_en, count(p.pixel_id) n_pixels from (values {_SCL_ROWS}) d(code, label_es, label_en)
    left join pixel p on p.scl = d.code group by 1,2,3"""
)
def scene_class_counts(spark, sf):
    """Pixels per scene class with its labels; classes that do not occur stay."""
    counts = s.pixel(spark, sf).groupBy(F.col("scl").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return dimensions.scl_dimension(spark).join(counts, "code", "left").select(
        "code", "label_es", "label_en", F.coalesce("n", F.lit(0)).alias("n_pixels")
    )


@query(
    s.with_views(
        "passing", "samples",
        listed="select reservoir_id, scene_date, min(cloud_pct) cloud_pct from passing group by 1,2",
        asked="select distinct reservoir_id, cast(ts as date) as d from samples",
    )
    + f"""select a.reservoir_id, a.d as "date", {sql_fixed('l.cloud_pct')} cloud_pct, l.cloud_pct is not null as known
    from asked a left join listed l on l.reservoir_id = a.reservoir_id and l.scene_date = a.d"""
)
def valid_date_lookup(spark, sf):
    """Cloud share of asked dates from the stored list; unknown dates stay with NULL."""
    listed = screening.scene_statistics(s.pixel(spark, sf)).where(screening.passes(60, 50))
    listed = listed.withColumnRenamed("scene_date", "date")
    asked = s.samples(spark, sf).select("reservoir_id", F.to_date("ts").alias("date")).distinct()
    return screening.cloud_of_dates(asked, listed).select(
        "reservoir_id", "date", fixed("cloud_pct").alias("cloud_pct"), F.col("cloud_pct").isNotNull().alias("known")
    )


# --- files a user starts with, written from the given tables and read back -----------------------------------
@query(
    s.with_views("edge", v=f"""select r_regionkey reservoir_id, r_name as name, c.vertex_no, c.x + 7e0*r_regionkey x, cast(c.y as double) y
      from region, (values {",".join(f"({k},{x},{y})" for k, (x, y) in enumerate(s.AOI_CORNERS))}) c(vertex_no, x, y)""")
    + """select v.name, v.vertex_no, v.x, v.y, b.minx, b.maxy from v
    join (select reservoir_id, min(x) minx, max(y) maxy from v group by 1) b using (reservoir_id)"""
)
def aoi_geojson(spark, sf):
    """Areas stored as GeoJSON, one file with polygons and one with multipolygons with holes, read back vertex by vertex."""
    corner = lambda p: F.array(p["x"], p["y"])
    areas = s.aoi(spark, sf).select("reservoir_id", "name", F.transform("ring", corner).alias("outer"))
    hole = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((300.0, 300.0), (310.0, 300.0), (310.0, 310.0), (300.0, 300.0))])
    rings = {0: F.to_json(F.array("outer", hole)), 1: F.to_json(F.array(F.array("outer", hole), F.array(hole)))}
    path = scratch_path(spark, "geojson")
    for odd, kind in ((0, "Polygon"), (1, "MultiPolygon")):
        feature = F.concat(
            F.lit('{"type":"Feature","properties":'), F.to_json(F.create_map(F.lit("NOMBRE"), F.col("name"))),
            F.lit(f',"geometry":{{"type":"{kind}","coordinates":'), rings[odd], F.lit("}}"),
        )
        listed = areas.where(F.pmod(F.col("reservoir_id"), F.lit(2)) == odd).agg(F.concat_ws(",", F.collect_list(feature)).alias("f"))
        listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("value")).write.mode("append").text(path)
    found = aoi_from_geojson(spark.read.text(path, wholetext=True).withColumnRenamed("value", "geojson"))
    vertices = found.select("name", "minx", "maxy", F.posexplode("ring").alias("vertex_no", "p"))
    return vertices.select("name", "vertex_no", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "minx", "maxy")


@query(
    s.with_views("poi")
    + """select 'R' || reservoir_id as reservoir, point, cast(y as double) lat, cast(x as double) lon, 'listed' as kind from poi union all
    select 'own', point, case when x % 5 <> 0 then cast(y as double) end, x + 0.5e0, 'uploaded' from poi"""
)
def points_csv(spark, sf):
    """Points of interest as the stored list and as an upload with other headers and unreadable numbers."""
    points, folder = s.poi(spark, sf), scratch_path(spark, "points")
    files.write_csv(points.select(F.concat(F.lit("R"), "reservoir_id").alias("embalse"), F.col("point").alias("nombre"), F.col("y").alias("latitud"), F.col("x").alias("longitud")), f"{folder}/listed")
    unreadable = F.when(F.col("x") % 5 != 0, F.col("y").cast("string")).otherwise("n/a")
    files.write_csv(points.select(F.col("point").alias("Nombre"), unreadable.alias("LATITUD "), (F.col("x") + 0.5).alias(" Longitud")), f"{folder}/own")
    listed, own = files.read_points(spark, f"{folder}/listed"), files.read_uploaded_points(spark, f"{folder}/own", "own")
    return listed.withColumn("kind", F.lit("listed")).unionByName(own.withColumn("kind", F.lit("uploaded")))


@query(
    s.with_views("scene")
    + f"""select 'R' || reservoir_id as reservoir, scene_date as "date", {sql_fixed('min(cloud_pct)')} cloud_pct from scene
    where scene_date >= date '1995-06-01' and scene_date <= date '1997-06-11' group by 1,2"""
)
def valid_dates_csv(spark, sf):
    """Precomputed dates of each reservoir as a file with repeated and unreadable dates, and the asked range of it."""
    scenes, folder = screening.scene_statistics(s.pixel(spark, sf)), scratch_path(spark, "dates")
    rows = scenes.select("reservoir_id", F.col("scene_date").cast("string").alias("fecha"), F.col("cloud_pct").alias("nubosidad"))
    bad = rows.select("reservoir_id", F.lit("no date").alias("fecha"), "nubosidad").distinct()
    rows.unionByName(bad).write.option("header", True).partitionBy("reservoir_id").csv(folder)
    keys = [r.r_regionkey for r in s.table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    read = [files.read_valid_dates(spark, f"{folder}/reservoir_id={k}", f"R{k}", "1995-06-01", "1997-06-11") for k in keys]
    return reshape.union_all(read).select("reservoir", "date", fixed("cloud_pct").alias("cloud_pct"))


@query(
    """select r_regionkey reservoir_id, 'phycocyanin' as variable, 'linear' as model_name, r_regionkey % 2 = 0 as available,
      p.place, p.predictor, case when r_regionkey % 2 = 0 then r_regionkey*0.5e0 + p.place end coefficient, r_regionkey + 0.25e0 intercept
    from region, (values (0,'NDCI_705_665'),(1,'R740_R665')) p(place, predictor)"""
)
def configuration_json(spark, sf):
    """Calibration configurations stored as JSON and read back predictor by predictor."""
    key, path = F.col("r_regionkey"), scratch_path(spark, "configuration")
    linear = key % 2 == 0
    stored = s.table(spark, sf, "region").select(
        key.cast("int").alias("reservoir_id"), F.lit("phycocyanin").alias("variable"), F.lit("linear").alias("model_name"), linear.alias("available"),
        F.lit(None).cast("string").alias("reason"), calibrated_band_name(F.lit("phycocyanin")).alias("band_name"), (key + 0.25).cast("double").alias("intercept"),
        F.array(F.lit("NDCI_705_665"), F.lit("R740_R665")).alias("predictor_set"),
        F.when(linear, F.array((key * 0.5).cast("double"), (key * 0.5 + 1).cast("double"))).alias("coefficients"),
        F.array(F.lit(0.1), F.lit(0.9)).alias("fill_values"),
    )
    files.write_json(stored, path)
    read = files.read_configs(spark, path)
    places = read.select("*", F.posexplode("predictor_set").alias("place", "predictor"))
    return places.select(
        "reservoir_id", "variable", "model_name", "available", "place", "predictor", F.get("coefficients", F.col("place")).alias("coefficient"), "intercept"
    )


@query(
    s.with_views("scene")
    + f"""select reservoir_id, scene_date, tile, {sql_stamp('scene_ts')} scene_ts,
      cast(least(greatest(floor(cloud_pct/20e0), 0), 4) as int) + 1 as class_no,
      case when cloud_pct < 20 then '0.0–20.0' when cloud_pct < 40 then '20.0–40.0' when cloud_pct < 60 then '40.0–60.0'
        when cloud_pct < 80 then '60.0–80.0' else '80.0–100.0' end as label from scene where cloud_pct is not null"""
)
def cloud_classes(spark, sf):
    """Scenes by equal classes of cloud share with their labels, times taken from epoch milliseconds."""
    scenes = screening.scene_statistics(s.pixel(spark, sf)).where(F.col("cloud_pct").isNotNull())
    edges = class_edges(0.0, 100.0, 5)
    number = F.least(F.greatest(F.floor(F.col("cloud_pct") / 20.0), F.lit(0)), F.lit(4)).cast("int") + 1
    placed = scenes.withColumn("edges", edges).withColumn("class_no", number)
    return placed.select(
        "reservoir_id", "scene_date", "tile", stamp(from_epoch_millis(F.unix_millis("scene_ts"))).alias("scene_ts"), "class_no",
        class_label(F.element_at("edges", F.col("class_no")), F.element_at("edges", F.col("class_no") + 1)).alias("label"),
    )
