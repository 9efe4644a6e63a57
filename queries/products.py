"""Indices, reservoir means, points, class areas and the mixed result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.functions import spectral
from limnoscope.operators import matching, reduction, reshape, screening, spatial
from limnoscope.plans.products import product_records
from limnoscope.session import scratch_path
from limnoscope.sources import sinks
from queries import standins as s
from queries.geometry import _WEIGHED, _sql_shares, _sql_weighted
from queries.registry import fixed, query, sql_fixed, sql_stamp, stamp

NAMES = spectral.WATER_QUALITY_NAMES
MAIN = ("MCI", "NDCI_ind", "PC_Val_cal")

# Reflectance and index formulas for the oracle.
_R = {b: f"({b}/10000e0)" for b in ("b3", "b4", "b5", "b6", "b7", "b8a")}


def _f(text: str) -> str:
    return text.format(**_R)


_NDCI = _f("({b5}-{b4})/nullif({b5}+{b4},0)")
_MCI = _f("{b5}-{b4}-({b6}-{b4})*40e0/75e0")


def _floor0(e: str) -> str:
    return f"case when ({e}) < 0 then 0e0 else ({e}) end"


SQL_INDEX = {
    "MCI": _MCI,
    "PCI_B5/B4": _f("{b5}/nullif({b4},0)"),
    "NDCI_ind": _NDCI,
    "PC_Val_cal": _floor0(_f("100e0/(1e0+exp(-4.6755e0*({b5}/nullif({b4},0)-1.9895e0)))")),
    "Chla_Val_cal": _floor0(f"450e0/(1e0+exp(-7.14e0*({_NDCI}-0.46e0)))"),
    "PC_Bellus_cal": _floor0(_f("16957e0*({b6}-(0.96e0*{b8a}+0.51e0*({b3}-{b8a})))+571e0")),
    "Chla_Bellus_cal": _floor0(f"112.78e0*{_NDCI}+10.779e0"),
    "UV_PC_Gral_cal": _floor0(_f("24.665e0*pow({b5}/nullif({b4},0), 3.4607e0)")),
}
SQL_PREDICTOR = {
    "NDCI_705_665": _NDCI,
    "MCI_705": _f("{b5}-({b4}+({b6}-{b4})*(40e0/75e0))"),
    "R705_R665": _f("{b5}/nullif({b4},0)"),
    "R740_R665": _f("{b6}/nullif({b4},0)"),
    "R783_R665": _f("{b7}/nullif({b4},0)"),
    "TB_740": _f("{b6}-{b5}"),
    "TB_783": _f("{b7}-{b5}"),
    "NDRE_783_705": _f("({b7}-{b5})/nullif({b7}+{b5},0)"),
    "NDRE_740_705": _f("({b6}-{b5})/nullif({b6}+{b5},0)"),
    "B5_B4_diff": _f("{b5}-{b4}"),
    "B6_B5_diff": _f("{b6}-{b5}"),
    "B7_B5_diff": _f("{b7}-{b5}"),
}
SQL_CLEAR = "scl not in (8,9,10)"
_SCREENED = "case when scl not in (4,5) then case when {} then 1e0 else 0e0 end end"
_BY_CLASS, _BY_PROBABILITY = _SCREENED.format("scl in (7,8,9,10)"), _SCREENED.format("cldprb >= 10")
SQL_WATER = f"(scl = 6 or (scl = 2 and year(scene_date) = {s.DARK_YEAR}))"


def _digits(name: str) -> int:
    """The power law reaches 1e9, where six decimals are beyond a double."""
    return 2 if name == "UV_PC_Gral_cal" else 6


def shown(name: str):
    return fixed(F.col(f"`{name}`"), _digits(name)).alias(name)


def sql_shown(name: str, expression: str | None = None) -> str:
    quoted = f'"{name}"'
    return f"{sql_fixed(expression or quoted, _digits(name))} as {quoted}"


def sql_index(name: str, water: bool = False) -> str:
    keep = f"{SQL_CLEAR} and {SQL_WATER}" if water else SQL_CLEAR
    return f"case when {keep} then {SQL_INDEX[name]} end"


@query(
    s.with_views("pixel")
    + "select pixel_id, reservoir_id, scene_date, tile, "
    + ", ".join(sql_shown(n, sql_index(n)) for n in NAMES)
    + " from pixel"
)
def spectral_indices(spark, sf):
    """The eight water-quality indices of every pixel, cloud-masked."""
    indexed = spectral.with_indices(s.pixel(spark, sf), NAMES)
    return indexed.select(
        "pixel_id", "reservoir_id", "scene_date", "tile", *[shown(n) for n in NAMES]
    )


@query(
    s.with_views("pixel")
    + "select pixel_id, "
    + ", ".join(f'{sql_fixed(e)} as "{n}"' for n, e in SQL_PREDICTOR.items())
    + " from pixel"
)
def predictor_bands(spark, sf):
    """The twelve calibration predictors of every pixel, without masks."""
    indexed = spectral.with_indices(s.pixel(spark, sf), spectral.PREDICTOR_NAMES)
    return indexed.select("pixel_id", *[fixed(n).alias(n) for n in spectral.PREDICTOR_NAMES])


@query(
    s.with_views("pixel")
    + f"select reservoir_id, scene_date, tile, {sql_fixed('avg(b4/10000e0)')} b4_mean, "
    + ", ".join(f'{sql_fixed(f"avg({e})")} as "{n}"' for n, e in SQL_PREDICTOR.items())
    + " from pixel group by 1,2,3"
)
def calibration_features(spark, sf):
    """Scene means of red reflectance and of all predictors."""
    scenes = matching.scene_features(s.pixel(spark, sf))
    return scenes.select(
        "reservoir_id", "scene_date", "tile", fixed("b4_mean").alias("b4_mean"),
        *[fixed(n).alias(n) for n in spectral.PREDICTOR_NAMES],
    )


_MEANS = (
    "select reservoir_id, scene_date, tile, scene_ts, "
    + ", ".join(f'avg({sql_index(n, True)}) as "{n}"' for n in NAMES)
    + " from best join pixel using (reservoir_id, scene_date, tile, scene_ts) group by 1,2,3,4"
)


@query(
    s.with_views("best", "pixel", means=_MEANS)
    + "select reservoir_id, scene_date, tile, "
    + ", ".join(sql_shown(n) for n in NAMES)
    + " from means where coalesce(" + ", ".join(f'"{n}"' for n in NAMES) + ") is not null"
)
def reservoir_daily_mean(spark, sf):
    """Water mean of every index for the best scene of each reservoir and date."""
    means = reduction.reservoir_daily_means(s.pixel(spark, sf), NAMES, dark_year=s.DARK_YEAR)
    return means.select("reservoir_id", "scene_date", "tile", *[shown(n) for n in NAMES])


_POINTS = (
    "select p.reservoir_id, p.scene_date, p.tile, min(p.scene_ts) scene_ts, poi.point, count(*) n_pixels, "
    + ", ".join(f'avg({sql_index(n)}) as "{n}"' for n in NAMES)
    + " from pixel p join poi on poi.reservoir_id = p.reservoir_id"
    " and (p.x-poi.x)*(p.x-poi.x) + (p.y-poi.y)*(p.y-poi.y) <= 900 group by 1,2,3,5"
)


@query(
    s.with_views("pixel", "poi", near=_POINTS)
    + "select reservoir_id, scene_date, tile, point, "
    + ", ".join(sql_shown(n) for n in NAMES)
    + " from near where coalesce(" + ", ".join(f'"{n}"' for n in NAMES) + ") is not null"
)
def poi_buffer_mean(spark, sf):
    """Mean of every index within 30 m of each point, per scene."""
    means = reduction.point_means(s.pixel(spark, sf), s.poi(spark, sf), NAMES)
    return means.select(
        "reservoir_id", "scene_date", "tile", "point", *[shown(n) for n in NAMES]
    )


def _sql_classes(name: str, edges) -> str:
    rows = ",".join(f"({i + 1},{lo}e0,{up}e0)" for i, (lo, up) in enumerate(zip(edges, edges[1:])))
    return f"""v as (select reservoir_id, scene_date, tile, area_m2, {sql_index(name, True)} as val from pixel),
    total as (select reservoir_id, scene_date, tile, coalesce(sum(case when val is not null then area_m2 end),0e0) t from v group by 1,2,3),
    cls as (select * from (values {rows}) c(class_no, low, up)),
    part as (select v.reservoir_id, v.scene_date, v.tile, c.class_no, sum(area_m2) a from v join cls c on v.val >= c.low and v.val < c.up group by 1,2,3,4)
    select t.reservoir_id, t.scene_date, t.tile, c.class_no, c.low, c.up,
      {sql_fixed('coalesce(p.a,0e0)/10000e0')} area_ha,
      {sql_fixed('case when t.t > 0 then 100e0*coalesce(p.a,0e0)/t.t else 0e0 end')} "percent"
    from total t join cls c on true left join part p on p.reservoir_id=t.reservoir_id and p.scene_date=t.scene_date
      and p.tile=t.tile and p.class_no=c.class_no"""


def _classes(spark, sf, name, edges):
    rows = reduction.area_by_class(s.pixel(spark, sf), name, edges, dark_year=s.DARK_YEAR)
    return rows.select(
        "reservoir_id", "scene_date", "tile", "class_no", "low", "up",
        fixed("area_ha").alias("area_ha"), fixed("percent").alias("percent"),
    )


@query(s.with_views("pixel").rstrip() + ",\n" + _sql_classes("NDCI_ind", s.NDCI_EDGES))
def area_by_class(spark, sf):
    """Water area per class of the normalised index, empty classes kept."""
    return _classes(spark, sf, "NDCI_ind", s.NDCI_EDGES)


@query(s.with_views("pixel").rstrip() + ",\n" + _sql_classes("NDCI_ind", s.PARTIAL_EDGES))
def area_by_class_partial(spark, sf):
    """Classes that leave values outside: shares then do not add up to 100."""
    return _classes(spark, sf, "NDCI_ind", s.PARTIAL_EDGES)


# --- result tables -------------------------------------------------------------------------------------
_BINS = {"NDCI_ind": s.PARTIAL_EDGES}
_LONG = f"""
 select reservoir_id, 'Media_Embalse' as location, scene_ts as ts, 'Valor Estimado' as kind, m.measure, m.value
   from means, lateral (values {",".join(f"('{n}', {chr(34)}{n}{chr(34)})" for n in MAIN)}) m(measure, value)
   where m.value is not null
 union all
 select near.reservoir_id, point, best.scene_ts, 'Valor Estimado', m.measure, m.value
   from near join best using (reservoir_id, scene_date, tile),
   lateral (values {",".join(f"('{n}', {chr(34)}{n}{chr(34)})" for n in MAIN)}) m(measure, value) where m.value is not null
 union all
 select reservoir_id, 'Distribucion_Embalse', scene_ts, 'Distribucion', m.measure, m.value from areas,
   lateral (values ('NDCI_ind -0.5–0.0 area_ha', a1/10000e0), ('NDCI_ind 0.0–0.5 area_ha', a2/10000e0),
     ('NDCI_ind -0.5–0.0 percent', case when t > 0 then 100e0*a1/t else 0e0 end),
     ('NDCI_ind 0.0–0.5 percent', case when t > 0 then 100e0*a2/t else 0e0 end)) m(measure, value)
 union all
 select reservoir_id, 'Sonda', ts, 'Valor Real', variable, value from samples where value is not null"""
_AREAS = f"""select reservoir_id, scene_date, scene_ts, coalesce(sum(case when v >= -0.5e0 and v < 0e0 then area_m2 end),0e0) a1,
  coalesce(sum(case when v >= 0e0 and v < 0.5e0 then area_m2 end),0e0) a2,
  coalesce(sum(case when v is not null then area_m2 end),0e0) t
  from (select pixel.*, {sql_index('NDCI_ind', True)} v from best join pixel using (reservoir_id, scene_date, tile, scene_ts)) group by 1,2,3"""
_MIXED = s.with_views(
    "best", "pixel", "poi", "samples", means=_MEANS, near=_POINTS, areas=_AREAS, records=_LONG
)


def _long(spark, sf):
    """Means, points, class areas and sensor values in one long table."""
    field = s.samples(spark, sf).select(
        "reservoir_id", F.lit("Sonda").alias("location"), "ts", F.lit(reduction.MEASURED).alias("kind"),
        F.col("variable").alias("measure"), "value",
    ).where(F.col("value").isNotNull())
    return product_records(
        s.pixel(spark, sf), MAIN, s.poi(spark, sf), bins=_BINS, dark_year=s.DARK_YEAR, sensors=[field]
    )


@query(
    _MIXED + f"select reservoir_id, location, {sql_stamp('ts')} ts, kind, measure, {sql_fixed('value')} as value from records"
)
def mixed_measures_long(spark, sf):
    """Means, points, class areas and sensors in one long table."""
    return _long(spark, sf).select(
        "reservoir_id", "location", stamp("ts").alias("ts"), "kind", "measure", fixed("value").alias("value")
    )


_WIDE = (
    "select reservoir_id, location, ts, kind, "
    + ", ".join(f"max(case when measure = '{n}' then value end) as \"{n}\"" for n in MAIN)
    + " from records where measure in (" + ", ".join(f"'{n}'" for n in MAIN) + ") group by 1,2,3,4"
)


@query(
    _MIXED.rstrip() + f",\nwide as ({_WIDE})\n"
    + f"select reservoir_id, location, {sql_stamp('ts')} ts, kind, "
    + ", ".join(sql_shown(n) for n in MAIN) + " from wide"
)
def mixed_measures_wide(spark, sf):
    """The index measures with one column each."""
    wide = reshape.to_wide(_long(spark, sf), MAIN)
    return wide.select(
        "reservoir_id", "location", stamp("ts").alias("ts"), "kind", *[shown(n) for n in MAIN]
    )


@query(
    _MIXED.rstrip() + f",\nwide as ({_WIDE})\n"
    + "select case when location = 'Media_Embalse' then 'mean' else 'point' end as part, location, reservoir_id, "
    + "strftime(ts, '%d-%m-%Y %H:%M') as shown, kind, "
    + ", ".join(sql_shown(n) for n in MAIN)
    + " from wide order by location, ts"
)
def result_tables(spark, sf):
    """Result tables of means and points, sorted by place and time, times formatted."""
    wide = reshape.to_wide(_long(spark, sf), MAIN)
    collapsed = reshape.collapse_means(wide, ["reservoir_id", "location", "ts", "kind"], MAIN)
    means, points = reshape.split_means(collapsed)
    both = reshape.union_all([means.withColumn("part", F.lit("mean")), points.withColumn("part", F.lit("point"))])
    return both.orderBy("location", "ts").select(
        "part", "location", "reservoir_id", F.date_format("ts", "dd-MM-yyyy HH:mm").alias("shown"), "kind",
        *[shown(n) for n in MAIN],
    )


@query(
    s.with_views("best", "pixel", means=_MEANS)
    + "select reservoir_id, scene_date, u.index_name, u.value from means, lateral (values "
    + ",".join(f"('{n}', {sql_fixed(chr(34) + n + chr(34), _digits(n))})" for n in NAMES)
    + ") u(index_name, value) where coalesce(" + ", ".join(f'means."{n}"' for n in NAMES) + ") is not null"
)
def index_unpivot(spark, sf):
    """Reservoir means with one row per index; missing values stay."""
    means = reduction.reservoir_daily_means(s.pixel(spark, sf), NAMES, dark_year=s.DARK_YEAR)
    rows = reshape.indices_to_rows(means, ["reservoir_id", "scene_date"], NAMES)
    return rows.select("reservoir_id", "scene_date", "index_name",
        F.when(F.col("index_name") == "UV_PC_Gral_cal", fixed("value", 2)).otherwise(fixed("value")).alias("value"),
    )


@query(
    _MIXED + f"""select reservoir_id, location, {sql_stamp('ts')} ts, measure, {sql_fixed('value')} as value from records
    where cast(ts as date) > (select max(cast(scene_ts as date)) from best) - 15
      and cast(ts as date) <= (select max(cast(scene_ts as date)) from best)"""
)
def recent_measures(spark, sf):
    """Records of the last 15 days up to the newest used scene."""
    from limnoscope.operators.sensors import recent

    scenes = screening.scene_statistics(s.pixel(spark, sf))
    newest = screening.best_scene_per_date(scenes, 60, 50).agg(F.max(F.to_date("scene_ts")).alias("d"))
    rows = _long(spark, sf).withColumn("date", F.to_date("ts"))
    return recent(rows, newest.scalar()).select(
        "reservoir_id", "location", stamp("ts").alias("ts"), "measure", fixed("value").alias("value")
    )


@query(
    s.with_views("pixel")
    + "select reservoir_id, scene_date, tile, x, y, area_m2/10000e0 as area_ha, "
    + ", ".join(f'{sql_fixed(sql_index(n))} as "{n.replace("/", "_")}"' for n in ("PCI_B5/B4", "MCI"))
    + " from pixel"
)
def product_export(spark, sf):
    """Index bands written by date under file-safe names and read back."""
    path = scratch_path(spark, "product")
    sinks.export_product(s.pixel(spark, sf), ["PCI_B5/B4", "MCI"], path)
    stored = spark.read.parquet(path)
    return stored.select(
        "reservoir_id", F.col("scene_date").cast("date").alias("scene_date"), "tile", "x", "y",
        (F.col("area_m2") / 10000).alias("area_ha"), fixed("PCI_B5_B4").alias("PCI_B5_B4"), fixed("MCI").alias("MCI"),
    )


@query(
    s.with_views(
        "pixel", "edge", **_sql_shares("pixel"), weighed=_WEIGHED.format("pixel"),
        weighed_scene=f"""select reservoir_id, scene_date, tile, min(scene_ts) scene_ts,
          coalesce(100e0*(0.95e0*{_sql_weighted(_BY_CLASS)} + 0.05e0*{_sql_weighted(_BY_PROBABILITY)}),
            100e0*{_sql_weighted(_BY_CLASS)}, 100e0*{_sql_weighted(_BY_PROBABILITY)}) cloud_pct,
          100e0*sum(case when b4 is not null then weight else 0e0 end)/sum(weight) coverage_count_pct, """
        + ", ".join(f'{_sql_weighted(sql_index(n, True))} as "{n}"' for n in MAIN) + " from weighed group by 1,2,3",
        weighed_best="""select * from (select *, row_number() over (partition by reservoir_id, scene_date order by cloud_pct, scene_ts, tile) rn
          from weighed_scene where cloud_pct <= 60 and coverage_count_pct >= 50) where rn = 1""",
    )
    + f"select reservoir_id, scene_date, tile, {sql_fixed('cloud_pct')} cloud_pct, {sql_fixed('coverage_count_pct')} coverage_count_pct, "
    + ", ".join(sql_shown(n) for n in MAIN)
    + " from weighed_best where coalesce(" + ", ".join(f'"{n}"' for n in MAIN) + ") is not null"
)
def reservoir_daily_mean_weighted(spark, sf):
    """Cloud, coverage and water means of the best scenes, pixels on the shore counting by the share inside the area."""
    weighed = spatial.weigh_by_aoi(s.pixel(spark, sf), s.aoi(spark, sf))
    means = reduction.reservoir_daily_means(weighed, MAIN, dark_year=s.DARK_YEAR, weight="weight")
    return means.select(
        "reservoir_id", "scene_date", "tile", fixed("cloud_pct").alias("cloud_pct"), fixed("coverage_count_pct").alias("coverage_count_pct"),
        *[shown(n) for n in MAIN],
    )


@query(
    s.with_views(
        "pixel", "edge", **_sql_shares("pixel"), weighed=_WEIGHED.format("pixel"),
        v=f"select reservoir_id, scene_date, tile, area_m2*weight as a, {sql_index('NDCI_ind', True)} as val from weighed",
        total="select reservoir_id, scene_date, tile, coalesce(sum(case when val is not null then a end), 0e0) t from v group by 1,2,3",
        cls="select * from (values " + ",".join(f"({i + 1},{lo}e0,{up}e0)" for i, (lo, up) in enumerate(zip(s.PARTIAL_EDGES, s.PARTIAL_EDGES[1:]))) + ") c(class_no, low, up)",
        part="select v.reservoir_id, v.scene_date, v.tile, c.class_no, sum(a) a from v join cls c on v.val >= c.low and v.val < c.up group by 1,2,3,4",
    )
    + f"""select t.reservoir_id, t.scene_date, t.tile, c.class_no, {sql_fixed('coalesce(p.a,0e0)/10000e0')} area_ha,
      {sql_fixed('case when t.t > 0 then 100e0*coalesce(p.a,0e0)/t.t else 0e0 end')} "percent"
    from total t join cls c on true left join part p on p.reservoir_id=t.reservoir_id and p.scene_date=t.scene_date
      and p.tile=t.tile and p.class_no=c.class_no"""
)
def area_by_class_weighted(spark, sf):
    """Areas of classes inside the area, pixels on the shore counting by the share inside."""
    weighed = spatial.weigh_by_aoi(s.pixel(spark, sf), s.aoi(spark, sf))
    rows = reduction.area_by_class(weighed, "NDCI_ind", s.PARTIAL_EDGES, dark_year=s.DARK_YEAR, weight="weight")
    return rows.select("reservoir_id", "scene_date", "tile", "class_no", fixed("area_ha").alias("area_ha"), fixed("percent").alias("percent"))


_SCALE = 60
_BANDS = ("PCI_B5/B4", "MCI")


@query(
    s.with_views(
        "pixel",
        v="select reservoir_id, scene_date, tile, cast(floor((x+10)/60) as bigint) cx, cast(floor((y+10)/60) as bigint) cy, area_m2, scl, "
        + ", ".join(f'{sql_index(n)} as "{n.replace("/", "_")}"' for n in _BANDS) + " from pixel",
        often="""select *, row_number() over (partition by reservoir_id, scene_date, tile, cx, cy order by n desc, scl) rn from
          (select reservoir_id, scene_date, tile, cx, cy, scl, count(*) n from v where scl is not null group by all)""",
        cells="select reservoir_id, scene_date, tile, cx, cy, sum(area_m2) area_m2, count(*) n_pixels, "
        + ", ".join(f'avg("{n.replace("/", "_")}") as "{n.replace("/", "_")}"' for n in _BANDS) + " from v group by 1,2,3,4,5",
    )
    + "select reservoir_id, scene_date, tile, (cx+0.5e0)*60e0-10e0 x, (cy+0.5e0)*60e0-10e0 y, area_m2, n_pixels, "
    + ", ".join(sql_fixed(f'"{b}"') + f' as "{b}"' for b in (n.replace("/", "_") for n in _BANDS))
    + """, o.scl from cells c left join (select * from often where rn = 1) o using (reservoir_id, scene_date, tile, cx, cy)"""
)
def product_export_scaled(spark, sf):
    """Index bands and scene classes on a grid of 60 m, written by date and read back."""
    path = scratch_path(spark, "product")
    sinks.export_product(s.pixel(spark, sf), list(_BANDS), path, scale=_SCALE, classes=["scl"])
    stored = spark.read.parquet(path)
    return stored.select(
        "reservoir_id", F.col("scene_date").cast("date").alias("scene_date"), "tile", "x", "y", "area_m2", "n_pixels",
        fixed("PCI_B5_B4").alias("PCI_B5_B4"), fixed("MCI").alias("MCI"), "scl",
    )


@query(
    s.with_views("pixel")
    + f"""select reservoir_id, scene_date, tile, {sql_fixed('avg((b8a/10000e0 - b4/10000e0)/nullif(b8a/10000e0 + b4/10000e0, 0))')} ndvi_narrow,
      {sql_fixed('avg(b3/10000e0)')} green from pixel where scl not in (8,9,10) group by 1,2,3"""
)
def registered_index(spark, sf):
    """Two indices of one's own, registered once and then used by name like any other; clouds masked."""
    own = {
        "ndvi_narrow": spectral.SpectralIndex("ndvi_narrow", ("b4", "b8a"), lambda r: F.try_divide(r["b8a"] - r["b4"], r["b8a"] + r["b4"]), cloud_masked=True),
        "green": spectral.SpectralIndex("green", ("b3",), lambda r: r["b3"], cloud_masked=True),
    }
    known = {i.name for i in spectral.catalogue()}
    for name, index in own.items():
        if name not in known:
            spectral.register(index)
    clear = s.pixel(spark, sf).where(~F.col("scl").isin(8, 9, 10))
    means = clear.groupBy("reservoir_id", "scene_date", "tile").agg(*reduction.aoi_means(list(own)))
    return means.select("reservoir_id", "scene_date", "tile", *[fixed(n).alias(n) for n in own])
