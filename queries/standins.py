"""Domain tables derived from the given tables, as Spark frames and as SQL common table expressions.

Derivations are plain projections of whole tables.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from limnoscope.sources.aoi import aoi_from_vertices

DARK_YEAR = 1998
# Corners of one area, shifted in x by 7 metres per reservoir.
AOI_CORNERS = [(53, 47), (823, 117), (703, 483), (857, 863), (297, 803), (117, 433), (53, 47)]
NDCI_EDGES = [round(-1.0 + 0.2 * i, 1) for i in range(11)]
PARTIAL_EDGES = [-0.5, 0.0, 0.5]

# --- pixel -----------------------------------------------------------------------------------------
_BASE = {
    "pixel_id": "l_orderkey*10+l_linenumber",
    "reservoir_id": "cast(l_suppkey % 5 as int)",
    "tile": "cast(l_linenumber % 2 as int)",
    "scene_date": "make_date(year(l_shipdate), month(l_shipdate),"
    " case when day(l_shipdate) <= 10 then 1 when day(l_shipdate) <= 20 then 11 else 21 end)",
    "x": "cast(20*(l_partkey % 45) as double)",
    "y": "cast(20*cast((l_partkey - l_partkey%45)/45 as bigint) as double)",
    "area_m2": "400.0e0",
    "b3": "cast(300+l_partkey%700 as double)",
    "b4": "case when l_orderkey % 13 = 0 then null else 200+l_quantity*40 end",
    "b5": "l_extendedprice/l_quantity",
    "b6": "(l_extendedprice/l_quantity)*(0.6e0+4*l_discount)",
    "b7": "(l_extendedprice/l_quantity)*(0.5e0+5*l_tax)",
    "b8a": "cast(150+(l_partkey*7)%900 as double)",
    "cldprb": "cast((l_orderkey*13+l_linenumber*5)%100 as int)",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
}
_CLOUD = "cast((dayofyear(scene_date)*37+reservoir_id*11+tile*29)%100 as int)"
_SCL = (
    "case when (l_orderkey*31+l_linenumber*17)%100 < cloud_meta then cast(7+(l_orderkey+l_linenumber)%4 as int)"
    " when l_orderkey%10=0 then 4 when l_orderkey%10=1 then 2 else 6 end"
)
_PIXEL_COLUMNS = (
    "pixel_id, reservoir_id, tile, scene_date, x, y, area_m2, b3, b4, b5, b6, b7, b8a, cldprb, cloud_meta"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in _BASE.items()])
    clouded = base.selectExpr("*", f"{_CLOUD} as cloud_meta")
    return clouded.selectExpr(
        *_PIXEL_COLUMNS.split(", "), f"{_SCL} as scl",
        "timestamp_seconds(unix_date(scene_date)*86400L + 39000 + 1200*tile) as scene_ts",
    )


_INSITU_VARIABLE = (
    "case when event_type in ('click','view') then 'phycocyanin'"
    " when event_type in ('purchase','error') then 'chlorophyll' else 'turbidity' end"
)


def samples_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "cast(user_id % 5 as int) as reservoir_id",
        "cast(ts as timestamp) - make_interval(0,0,0,10592,0,0,0)"
        " + make_interval(0,0,0,cast(user_id*15 as int),0,0,0) as ts",
        f"{_INSITU_VARIABLE} as variable", "event_type", "value",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field samples: time, reservoir, variable and value."""
    return samples_of(table(spark, sf_dir, "events"))


def feed_of(once: DataFrame) -> DataFrame:
    """Sensor feed in which each seventh row arrives twice and each eleventh has no measures."""
    arrivals = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1_000_000_000))).otherwise(F.array(F.lit(0)))
    both = once.withColumn("_later", F.explode(arrivals)).withColumn("ingest_id", F.col("event_id") + F.col("_later"))
    present = F.col("event_id") % 11 != 0
    return both.select(
        F.col("ts").alias("date_time"), F.col("reservoir_id").cast("string").alias("reservoir_code"),
        F.lit(-1.5).alias("lon"), F.lit(41.5).alias("lat"),
        F.when(present, F.col("value")).alias("phycocyanin"),
        F.when(present, F.col("value") / 10).alias("water_temp"),
        F.col("event_id").cast("double").alias("depth"), F.lit(None).cast("double").alias("ph"),
        F.lit(None).cast("double").alias("turbidity"), F.lit(None).cast("double").alias("chlorophyll"),
        "ingest_id",
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_of(samples(spark, sf_dir))


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name as point", "cast(n_regionkey % 5 as int) as reservoir_id",
        "36*n_nationkey+7 as x", "(n_nationkey*n_nationkey*13)%900 as y",
    )


def aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring per region."""
    corners = F.posexplode(F.array(*[F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy")) for x, y in AOI_CORNERS]))
    vertices = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("reservoir_id"), F.col("r_name").alias("name"), corners.alias("vertex_no", "c")
    )
    return aoi_from_vertices(
        vertices.select(
            "reservoir_id", "name", "vertex_no",
            (F.col("c.cx") + 7 * F.col("reservoir_id")).alias("x"), F.col("c.cy").alias("y"),
        )
    )


# --- SQL ---------------------------------------------------------------------------------------------
_edges = ",".join(f"({a[0]},{a[1]},{b[0]},{b[1]})" for a, b in zip(AOI_CORNERS, AOI_CORNERS[1:]))
_AGG_SCENE = """
  select reservoir_id, scene_date, tile, min(scene_ts) scene_ts, min(cloud_meta) cloud_meta, count(*) n_pixels,
    coalesce(100.0e0*(0.95e0*avg(case when scl not in (4,5) then case when scl in (7,8,9,10) then 1e0 else 0e0 end end)
      + 0.05e0*avg(case when scl not in (4,5) then case when cldprb >= 10 then 1e0 else 0e0 end end)),
      100.0e0*avg(case when scl not in (4,5) then case when scl in (7,8,9,10) then 1e0 else 0e0 end end),
      100.0e0*avg(case when scl not in (4,5) then case when cldprb >= 10 then 1e0 else 0e0 end end)) cloud_pct,
    100.0e0*count(b4)/count(*) coverage_count_pct,
    coalesce(100.0e0*sum(case when b4 is not null then area_m2 end)/sum(area_m2), 0e0) coverage_area_pct
  from pixel group by 1,2,3"""

VIEWS = {
    "pixel": "select " + _PIXEL_COLUMNS + f", {_SCL} as scl,"
    " cast(scene_date as timestamp) + (650+20*tile) * interval 1 minute as scene_ts"
    f" from (select *, {_CLOUD} as cloud_meta from (select " + ", ".join(f"{e} as {c}" for c, e in _BASE.items()) + " from lineitem))",
    "samples": "select event_id, cast(user_id % 5 as int) as reservoir_id,"
    " ts - interval 10592 day + user_id*15 * interval 1 day as ts,"
    f" {_INSITU_VARIABLE} as variable, event_type, value from events",
    "poi": "select n_name as point, cast(n_regionkey % 5 as int) as reservoir_id, 36*n_nationkey+7 as x,"
    " (n_nationkey*n_nationkey*13)%900 as y from nation",
    "edge": "select r_regionkey as reservoir_id, r_name as name, e.x1+7*r_regionkey as x1, e.y1, e.x2+7*r_regionkey as x2, e.y2"
    f" from region, (values {_edges}) e(x1,y1,x2,y2)",
    "scene": _AGG_SCENE,
    "scene_box": "select reservoir_id, scene_date, tile, min(scene_ts) scene_ts, min(cloud_meta) cloud_meta,"
    " min(x) minx, min(y) miny, max(x) maxx, max(y) maxy from pixel group by 1,2,3",
    "passing": "select * from scene where cloud_pct <= 60 and coverage_count_pct >= 50",
    "best": "select * from (select *, row_number() over (partition by reservoir_id, scene_date"
    " order by cloud_pct, scene_ts, tile) rn from passing) where rn = 1",
    "feed": """select ts as date_time, cast(reservoir_id as varchar) as reservoir_code,
      case when event_id % 11 <> 0 then value end as phycocyanin,
      case when event_id % 11 <> 0 then value/10 end as water_temp, cast(event_id as double) as depth, ingest_id
      from (select *, event_id as ingest_id from samples union all
            select *, event_id + 1000000000 as ingest_id from samples where event_id % 7 = 0)""",
}
VIEWS |= {
    "usable": "select *, coverage_area_pct >= 50 as valid from scene where cloud_meta <= 60",
    "asked": "select distinct reservoir_id, cast(ts as date) as d from samples where hour(ts) between 8 and 15",
    "satellite": """select * from (select a.reservoir_id, a.d, u.scene_date, u.tile, u.scene_ts, u.cloud_meta,
        u.coverage_area_pct, u.valid, abs(date_diff('day', u.scene_date, a.d)) days_away,
        hour(u.scene_ts) + minute(u.scene_ts)/60e0 as overpass,
        count(*) over (partition by a.reservoir_id, a.d) n_candidates,
        row_number() over (partition by a.reservoir_id, a.d order by u.valid desc, abs(date_diff('day', u.scene_date, a.d)),
          u.cloud_meta, u.coverage_area_pct desc, u.scene_ts, u.tile) rn
      from asked a join usable u on u.reservoir_id = a.reservoir_id and u.scene_date between a.d - 3 and a.d + 3) where rn = 1""",
    "near": """select s.*, t.d, t.overpass from samples s join satellite t on t.reservoir_id = s.reservoir_id
        and t.d = cast(s.ts as date) and t.valid
      where hour(s.ts) between 8 and 15
        and abs(hour(s.ts) + minute(s.ts)/60e0 + second(s.ts)/3600e0 - t.overpass) <= 1.5""",
    "daily": """select reservoir_id, d, variable, overpass, avg(value) value_mean, median(value) value_median,
        min(value) value_min, max(value) value_max, count(*) n_obs from near group by 1,2,3,4""",
    "feature": """select reservoir_id, scene_date, tile, avg((b5/10000e0-b4/10000e0)/nullif(b5/10000e0+b4/10000e0,0)) ndci,
        avg(b6/nullif(b4,0)) r740, avg(b7/10000e0-b5/10000e0) tb783 from pixel group by 1,2,3""",
    "calib": """select g.*, count(*) over (partition by reservoir_id, variable) n_rows from (
        select y.reservoir_id, y.variable, y.d, y.value_mean y_true, f.ndci, f.r740, f.tb783
        from daily y join satellite t on t.reservoir_id = y.reservoir_id and t.d = y.d
        join feature f on f.reservoir_id = t.reservoir_id and f.scene_date = t.scene_date and f.tile = t.tile
        where f.ndci is not null and f.r740 is not null and f.tb783 is not null and t.valid) g""",
    "gated": "select * from calib where n_rows >= 6",
    "held": """select *, case when rank() over (partition by reservoir_id, variable
        order by md5(concat_ws('|', 'holdout', reservoir_id, variable, d))) <=
        ceil(n_rows * case when n_rows < 8 then 0.20e0 else 0.25e0 end) then 'test' else 'train' end split from gated""",
    "fence": """select reservoir_id, variable, q1 - 1.5e0*(q3-q1) low, q3 + 1.5e0*(q3-q1) high from (
        select reservoir_id, variable, count(*) n, quantile_cont(y_true, 0.25) q1, quantile_cont(y_true, 0.75) q3
        from held where split = 'train' group by 1,2) where n >= 8""",
    "cleaned": """select h.* exclude (split), case when h.split = 'train' and (h.y_true < f.low or h.y_true > f.high) then 'outlier'
        else h.split end split from held h left join fence f using (reservoir_id, variable)""",
    # Groups with fewer than five train rows get no models.
    "modelled": """select * from cleaned join (select reservoir_id, variable from cleaned where split = 'train'
        group by 1,2 having count(*) >= 5) using (reservoir_id, variable)""",
    "trained": """select *, row_number() over (partition by reservoir_id, variable
          order by md5(concat_ws('|', 'kfold', reservoir_id, variable, d))) hash_rank,
        row_number() over (partition by reservoir_id, variable order by d) day_rank,
        count(*) over (partition by reservoir_id, variable) n_train from cleaned where split = 'train'""",
    "folded": """select *, cast((hash_rank - 1) % least(5, n_train) as int) fold,
        cast(case when day_rank - 1 < n_train - k * (n_train // (k+1)) then 0
          else (day_rank - 1 - (n_train - k * (n_train // (k+1)))) // (n_train // (k+1)) + 1 end as int) block
        from (select *, least(5, greatest(2, n_train - 1)) k from trained)""",
    "folded_modelled": "select * from folded where n_train >= 5",
}
_NEEDS = {
    "scene": ["pixel"], "scene_box": ["pixel"], "passing": ["scene"], "best": ["passing"], "feed": ["samples"],
    "usable": ["scene"], "asked": ["samples"], "satellite": ["asked", "usable"], "near": ["samples", "satellite"],
    "daily": ["near"], "feature": ["pixel"], "calib": ["daily", "satellite", "feature"], "gated": ["calib"],
    "held": ["gated"], "fence": ["held"], "cleaned": ["held", "fence"], "trained": ["cleaned"], "folded": ["trained"],
    "modelled": ["cleaned"], "folded_modelled": ["folded"],
}


def with_views(*names: str, **extra: str) -> str:
    """`with ...` prelude holding the named views, what they need, and extra ones in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({VIEWS[n]})" for n in ordered] + [f"{n} as ({sql})" for n, sql in extra.items()]
    return "with " + ",\n".join(parts) + "\n"
