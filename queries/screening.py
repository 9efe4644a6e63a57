"""Which scenes can be used: scan, cloud, coverage, thresholds, best scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.operators import screening, spatial
from limnoscope.plans import screening as plan
from queries import standins as s
from queries.registry import fixed, query, sql_fixed, sql_stamp, stamp

START, END, LATE_END = "1996-01-01", "1999-06-11", "1999-06-12"


@query(
    s.with_views("scene_box", "edge", box="select reservoir_id, min(x1) ax1, min(y1) ay1, max(x1) ax2, max(y1) ay2 from edge group by 1")
    + f"""select reservoir_id, count(*) n_scenes,
      sum(case when scene_date < date '{END}' then 1 else 0 end)::bigint n_half_open,
      sum(case when cloud_meta <= 60 then 1 else 0 end)::bigint n_clear
    from scene_box join box using (reservoir_id)
    where scene_date >= date '{START}' and scene_date <= date '{END}'
      and minx <= ax2 and maxx >= ax1 and miny <= ay2 and maxy >= ay1
    group by 1"""
)
def scene_scan(spark, sf):
    """Scenes per reservoir in a date range that overlap its area, both ends and half-open, under a cloud limit."""
    scenes = screening.scenes_of(s.pixel(spark, sf))
    found = screening.scene_search(scenes, START, END, boxes=s.aoi(spark, sf), inclusive_end=True)
    return found.groupBy("reservoir_id").agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.count_if(F.col("scene_date") < F.lit(END).cast("date")).alias("n_half_open"),
        F.count_if(F.col("cloud_meta") <= 60).alias("n_clear"),
    )


@query(
    s.with_views("scene")
    + f"""select reservoir_id, scene_date, tile, n_pixels, {sql_stamp('scene_ts')} scene_ts, {sql_fixed('cloud_pct')} cloud_pct,
      {sql_fixed('coverage_count_pct')} coverage_count_pct, {sql_fixed('coverage_area_pct')} coverage_area_pct from scene"""
)
def scene_cloud_coverage(spark, sf):
    """Cloud and coverage of every scene."""
    return screening.scene_statistics(s.pixel(spark, sf)).select(
        "reservoir_id", "scene_date", "tile", "n_pixels", stamp("scene_ts").alias("scene_ts"),
        fixed("cloud_pct").alias("cloud_pct"),
        fixed("coverage_count_pct").alias("coverage_count_pct"),
        fixed("coverage_area_pct").alias("coverage_area_pct"),
    )


_INSIDE = """select p.* from pixel p where (select count(*) from edge e where e.reservoir_id = p.reservoir_id
  and (e.y1 > p.y) <> (e.y2 > p.y) and e.x1 + (p.y - e.y1) * (e.x2 - e.x1) * 1.0e0 / (e.y2 - e.y1) > p.x) % 2 = 1"""


@query(
    s.with_views("pixel", "edge", clipped=_INSIDE, scene=s.VIEWS["scene"].replace("from pixel", "from clipped"))
    + f"""select reservoir_id, scene_date, tile, n_pixels, {sql_fixed('cloud_pct')} cloud_pct,
      {sql_fixed('coverage_count_pct')} coverage_count_pct from scene"""
)
def aoi_cloud_coverage(spark, sf):
    """Cloud and coverage over the pixels inside each area."""
    clipped = spatial.clip_to_aoi(s.pixel(spark, sf), s.aoi(spark, sf))
    return screening.scene_statistics(clipped).select(
        "reservoir_id", "scene_date", "tile", "n_pixels",
        fixed("cloud_pct").alias("cloud_pct"), fixed("coverage_count_pct").alias("coverage_count_pct"),
    )


@query(
    s.with_views("scene")
    + f"""select reservoir_id, scene_date, {sql_fixed('cloud_pct')} cloud_pct from (
      select *, row_number() over (partition by reservoir_id, scene_date order by scene_ts, tile) rn
      from scene where cloud_pct <= 60 and coverage_count_pct >= 90) where rn = 1"""
)
def valid_dates(spark, sf):
    """Dates with a passing scene, with the cloud share of the first one."""
    scenes = screening.scene_statistics(s.pixel(spark, sf))
    found = screening.valid_dates(scenes, 60, 90)
    return found.select("reservoir_id", "scene_date", fixed("cloud_pct").alias("cloud_pct"))


@query(
    s.with_views(
        "pixel", "edge", clipped=_INSIDE + f" and p.scene_date >= date '{START}' and p.scene_date < date '{LATE_END}'",
        scene=s.VIEWS["scene"].replace("from pixel", "from clipped"),
    )
    + f"""select reservoir_id, scene_date, {sql_fixed('cloud_pct')} cloud_pct from (
      select *, row_number() over (partition by reservoir_id, scene_date order by scene_ts, tile) rn
      from scene where cloud_pct <= 60 and coverage_count_pct >= 50) where rn = 1 order by 1, 2"""
)
def usable_dates(spark, sf):
    """Usable dates of a range over the areas, as the stored list of valid dates holds them."""
    found = plan.usable_dates(s.pixel(spark, sf), START, LATE_END, s.aoi(spark, sf))
    return found.select("reservoir_id", "scene_date", fixed("cloud_pct").alias("cloud_pct"))


@query(
    s.with_views("scene")
    + """select distinct reservoir_id, scene_date from scene where coverage_count_pct >= 90 and cloud_pct is not null"""
)
def valid_dates_any_cloud(spark, sf):
    """A cloud limit of 100 lets every scene with a computable share pass."""
    scenes = screening.scene_statistics(s.pixel(spark, sf))
    return screening.valid_dates(scenes, 100, 90).select("reservoir_id", "scene_date")


@query(
    s.with_views("best")
    + f"""select reservoir_id, scene_date, tile, {sql_stamp('scene_ts')} scene_ts, {sql_fixed('cloud_pct')} cloud_pct,
      {sql_fixed('coverage_count_pct')} coverage_count_pct from best"""
)
def best_scene_per_date(spark, sf):
    """Least cloudy passing scene of each reservoir and date."""
    scenes = screening.scene_statistics(s.pixel(spark, sf))
    return screening.best_scene_per_date(scenes, 60, 50).select(
        "reservoir_id", "scene_date", "tile", stamp("scene_ts").alias("scene_ts"),
        fixed("cloud_pct").alias("cloud_pct"), fixed("coverage_count_pct").alias("coverage_count_pct"),
    )


@query(
    s.with_views("best")
    + f"""select reservoir_id, strftime(scene_ts, '%Y-%m-%d') report_date, strftime(scene_ts, '%H:%M:%S') report_time,
      {sql_fixed('cloud_pct', 2)} cloud_pct, {sql_fixed('coverage_count_pct', 2)} coverage_pct from best"""
)
def cloud_report(spark, sf):
    """Cloud report of the used scenes, rounded for reading."""
    scenes = screening.scene_statistics(s.pixel(spark, sf))
    best = screening.best_scene_per_date(scenes, 60, 50)
    return best.select(
        "reservoir_id", F.date_format("scene_ts", "yyyy-MM-dd").alias("report_date"),
        F.date_format("scene_ts", "HH:mm:ss").alias("report_time"),
        fixed("cloud_pct", 2).alias("cloud_pct"), fixed("coverage_count_pct", 2).alias("coverage_pct"),
    )
