"""Field samples prepared and matched to scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.functions.temporal import clock
from limnoscope.operators import matching, quantiles, screening
from limnoscope.session import cut_lineage
from queries import standins as s
from queries.registry import fixed, query, sql_fixed, sql_stamp, stamp

PREDICTORS = ("NDCI_705_665", "R740_R665", "TB_783")


def prepared(spark, sf, first=8, last=15):
    rows = s.samples(spark, sf)
    return matching.prepare_insitu(rows, F.col("ts"), F.col("value"), F.col("variable"), first, last)


def satellite(spark, sf, predictors=()):
    dates = cut_lineage(matching.insitu_dates(prepared(spark, sf)))
    near = matching.pixels_around(s.pixel(spark, sf), dates, 3, 60)
    scenes = matching.scene_features(near, predictors or PREDICTORS)
    return matching.match_scenes(dates, scenes, 3, 60, 50, predictors)


@query(
    s.with_views("samples")
    + """select event_id, reservoir_id, variable, value, cast(ts as date) as "date", strftime(ts, '%H:%M:%S') as "time"
    from samples where value is not null and hour(ts) between 8 and 15"""
)
def insitu_prepared(spark, sf):
    """Readable samples of the working hours."""
    rows = matching.prepare_insitu(
        s.samples(spark, sf), F.col("ts"), F.col("value"), F.col("variable"), 8, 15, keep=("reservoir_id", "event_id")
    )
    return rows.select("event_id", "reservoir_id", "variable", "value", "date", clock(F.col("ts")).alias("time"))


_STATS = ("n_obs", "value_mean", "value_median", "value_min", "value_max")


@query(
    s.with_views("samples")
    + f"""select reservoir_id, cast(ts as date) as "date", variable, count(*) n_obs, {sql_fixed('avg(value)')} value_mean,
      {sql_fixed('median(value)')} value_median, {sql_fixed('min(value)')} value_min, {sql_fixed('max(value)')} value_max
    from samples group by 1,2,3"""
)
def insitu_daily_stats(spark, sf):
    """Daily mean, exact median, range and count."""
    rows = matching.daily_statistics(prepared(spark, sf, 0, 23))
    return rows.select("reservoir_id", "date", "variable", "n_obs", *[fixed(c).alias(c) for c in _STATS[1:]])


@query(
    s.with_views("samples")
    + """select min(cast(ts as date)) first_date, max(cast(ts as date)) last_date from samples
    where value is not null and hour(ts) between 8 and 15"""
)
def insitu_extent(spark, sf):
    """First and last field date."""
    return matching.date_extent(prepared(spark, sf))


@query(
    s.with_views("satellite")
    + f"""select reservoir_id, d as "date", scene_date sentinel_date, tile, days_away days_from_insitu, {sql_stamp('scene_ts')} datetime_utc,
      {sql_fixed('overpass')} overpass_hour_utc, cloud_meta cloudy_pixel_percentage,
      {sql_fixed('coverage_area_pct')} coverage_percentage_aoi, valid valid_final, n_candidates from satellite"""
)
def scene_match_interval(spark, sf):
    """Best scene within three days of each field date."""
    found = satellite(spark, sf)
    return found.select(
        "reservoir_id", "date", "sentinel_date", "tile", F.col("days_from_insitu").cast("long").alias("days_from_insitu"),
        stamp("scene_ts").alias("datetime_utc"), fixed("overpass_hour_utc").alias("overpass_hour_utc"),
        "cloudy_pixel_percentage", fixed("coverage_percentage_aoi").alias("coverage_percentage_aoi"),
        "valid_final", "n_candidates",
    )


@query(
    s.with_views("satellite")
    + "select reservoir_id, count(*) n_dates, count_if(valid)::bigint n_valid, sum(n_candidates)::bigint n_pairs from satellite group by 1"
)
def scene_match_counts(spark, sf):
    """Matched dates, valid matches and candidate pairs per reservoir."""
    return satellite(spark, sf).groupBy("reservoir_id").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if("valid_final").alias("n_valid"),
        F.sum("n_candidates").alias("n_pairs"),
    )


@query(
    s.with_views("daily")
    + f"""select reservoir_id, d as "date", variable, n_obs, {sql_fixed('overpass')} overpass_hour_utc, """
    + ", ".join(f"{sql_fixed(c)} {c}" for c in _STATS[1:]) + " from daily"
)
def overpass_match(spark, sf):
    """Statistics of the samples within 1.5 hours of the overpass."""
    rows = matching.match_overpass(prepared(spark, sf), cut_lineage(satellite(spark, sf)))
    return rows.select(
        "reservoir_id", "date", "variable", "n_obs", fixed("overpass_hour_utc").alias("overpass_hour_utc"),
        *[fixed(c).alias(c) for c in _STATS[1:]],
    )


@query(
    s.with_views("satellite")
    + """select distinct s.reservoir_id, cast(s.ts as date) as "date" from samples s join satellite t
    on t.reservoir_id = s.reservoir_id and t.d = cast(s.ts as date) and t.valid where hour(s.ts) between 8 and 15"""
)
def date_intersection(spark, sf):
    """Dates that have both field samples and a valid scene."""
    return matching.shared_dates(prepared(spark, sf), satellite(spark, sf))


_NARROW = "20e0 + l_orderkey / 2e7 + l_linenumber / 3e8"


@query(
    f"""with v as (select l_suppkey % 3 as g, {_NARROW} as value from lineitem)
    select g, count(*) n_obs, """
    + ", ".join(sql_fixed(f"quantile_cont(value, {p})", 9) + f" {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q99", 0.99)))
    + " from v group by 1"
)
def quantiles_hot_groups(spark, sf):
    """Quantiles of groups whose values lie close together, by the way of large groups."""
    rows = s.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("g"), F.expr(_NARROW.replace("e0", "D").replace("2e7", "2e7D").replace("3e8", "3e8D")).alias("value"))
    found = quantiles.grouped_distribution(rows, ["g"], "value", {"q1": 0.25, "median": 0.5, "q99": 0.99}, small_group_rows=100)
    return found.select("g", "n_obs", *[fixed(n, 9).alias(n) for n in ("q1", "median", "q99")])


# Overpasses shifted to both sides of midnight.
@query(
    s.with_views(
        "samples", "scene",
        passes="select reservoir_id, tile, scene_ts + interval 13 hour as pass_ts from scene",
        met="""select s.event_id, s.reservoir_id, s.ts, p.pass_ts, p.tile, row_number() over (partition by s.event_id
            order by abs(epoch_us(p.pass_ts) - epoch_us(s.ts)), p.pass_ts, p.tile) rn
          from samples s join passes p on p.reservoir_id = s.reservoir_id and p.pass_ts between s.ts - interval 10 hour and s.ts + interval 10 hour""",
    )
    + f"""select event_id, reservoir_id, {sql_stamp('ts')} ts, {sql_stamp('pass_ts')} pass_ts, tile,
      {sql_fixed('(epoch_us(pass_ts) - epoch_us(ts))/1e6', 3)} seconds_away, cast(ts as date) <> cast(pass_ts as date) other_day from met where rn = 1"""
)
def nearest_overpass(spark, sf):
    """The overpass nearest in time to each sample, at most ten hours away, on whichever side of midnight."""
    passes = screening.scene_statistics(s.pixel(spark, sf)).select(
        "reservoir_id", "tile", (F.col("scene_ts") + F.expr("interval 13 hours")).alias("pass_ts")
    )
    samples = s.samples(spark, sf).select("event_id", "reservoir_id", "ts")
    found = matching.nearest_in_time(samples, passes, ["reservoir_id"], "ts", "pass_ts", 36_000, ["tile"])
    return found.select(
        "event_id", "reservoir_id", stamp("ts").alias("ts"), stamp("pass_ts").alias("pass_ts"), "tile", fixed("seconds_away", 3).alias("seconds_away"),
        (F.to_date("ts") != F.to_date("pass_ts")).alias("other_day"),
    )
