"""Field samples and scenes matched in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnoscope.functions import spectral, temporal
from limnoscope.functions.numeric import lenient_double
from limnoscope.operators import reduction, screening
from limnoscope.operators.quantiles import grouped_distribution
from limnoscope.operators.sizing import lookup_join
from limnoscope.session import cut_lineage


def prepare_insitu(
    samples: DataFrame, ts: Column, value: Column, variable: Column, first_hour: int = 0, last_hour: int = 23,
    keep: Sequence[str] = ("reservoir_id",),
) -> DataFrame:
    """Rows with a readable time and value inside the hour window, with their date and clock time."""
    parsed = samples.select(
        *keep, variable.alias("variable"), ts.alias("ts"), lenient_double(value.cast("string")).alias("value")
    )
    kept = parsed.na.drop(subset=["ts", "value"]).where(
        temporal.hour_within(F.col("ts"), first_hour, last_hour)
    )
    return kept.withColumns({"date": F.to_date("ts"), "time": temporal.clock(F.col("ts"))})


def insitu_dates(insitu: DataFrame) -> DataFrame:
    return insitu.select("reservoir_id", "date").distinct()


def date_extent(insitu: DataFrame) -> DataFrame:
    return insitu.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def pixels_around(pixels: DataFrame, dates: DataFrame, window_days: int, max_cloud: float) -> DataFrame:
    """Only pixels that can matter: clear enough by metadata and near a field date.

    Both tests are applied before the aggregation. The date test is an equi semi join at every size; the planner
    broadcasts the dates when they turn out small.
    """
    clear = pixels.where(F.col("cloud_meta") <= max_cloud)
    around = F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days))
    wanted = dates.select("reservoir_id", F.explode(around).alias("scene_date")).distinct()
    return clear.join(wanted, ["reservoir_id", "scene_date"], "left_semi")


def scene_features(pixels: DataFrame, predictors: Sequence[str] = spectral.PREDICTOR_NAMES) -> DataFrame:
    """Screening figures, mean red reflectance and predictor means of every scene, in one scan."""
    spectral.check_bands(pixels, predictors)
    red = F.avg(spectral.reflectance("b4")).alias("b4_mean")
    return screening.scene_statistics(pixels, extra=[red, *reduction.aoi_means(predictors)])


def match_scenes(
    dates: DataFrame,
    scenes: DataFrame,
    window_days: int = 3,
    max_cloud: float = 60,
    min_coverage: float = 50,
    predictors: Sequence[str] = (),
) -> DataFrame:
    """Best scene within `window_days` of each field date.

    Order: valid, fewest days away, least cloud, most coverage, earliest. Scenes of one day are all
    equally far from a field date, so they are cut to the best of the day first; each field date then
    meets at most 2N+1 rows by plain equality, and no range join is needed.
    """
    usable = scenes.where(F.col("cloud_meta") <= max_cloud).withColumns(
        {
            "valid_by_cloud": F.col("cloud_meta") <= max_cloud,
            "valid_by_coverage": F.col("coverage_area_pct") >= float(min_coverage),
        }
    )
    usable = usable.withColumn("valid_final", F.col("valid_by_cloud") & F.col("valid_by_coverage"))
    order = [
        F.col("valid_final"),
        (-F.col("cloud_meta")).alias("less_cloud"),
        F.col("coverage_area_pct"),
        (-F.unix_micros("scene_ts")).alias("earlier"),
        (-F.col("tile")).alias("lower_tile"),
    ]
    carried = ["tile", "scene_ts", "cloud_meta", "valid_by_cloud", "valid_by_coverage", *predictors]
    daily = usable.groupBy("reservoir_id", "scene_date").agg(
        F.max(F.struct(*order, *carried)).alias("s"), F.count(F.lit(1)).alias("n")
    )
    around = F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days))
    wanted = dates.select("reservoir_id", "date", F.explode(around).alias("scene_date"))
    days_away = F.abs(F.date_diff("scene_date", "date"))
    ranked = F.struct(
        F.col("s.valid_final").alias("valid_final"), (-days_away).alias("nearer"),
        F.col("s.less_cloud").alias("less_cloud"), F.col("s.coverage_area_pct").alias("coverage"),
        F.col("s.earlier").alias("earlier"), F.col("s.lower_tile").alias("lower_tile"),
        F.col("scene_date").alias("scene_date"), F.col("s").alias("s"),
    )
    chosen = (
        wanted.join(daily, ["reservoir_id", "scene_date"])
        .groupBy("reservoir_id", "date")
        .agg(F.max(ranked).alias("b"), F.sum("n").alias("n_candidates"))
    )
    value = lambda name: F.when(F.col("b.valid_final"), F.col("b.s")[name])
    return chosen.select(
        "reservoir_id", "date", F.col("b.scene_date").alias("sentinel_date"), F.col("b.s.tile").alias("tile"),
        (-F.col("b.nearer")).alias("days_from_insitu"),
        F.col("b.s.scene_ts").alias("scene_ts"),
        temporal.fractional_hour(F.col("b.s.scene_ts")).alias("overpass_hour_utc"),
        F.col("b.s.cloud_meta").alias("cloudy_pixel_percentage"),
        F.col("b.coverage").alias("coverage_percentage_aoi"),
        F.col("b.s.valid_by_cloud").alias("valid_by_cloud"),
        F.col("b.s.valid_by_coverage").alias("valid_by_coverage"),
        F.col("b.valid_final").alias("valid_final"),
        "n_candidates",
        *[value(p).alias(p) for p in predictors],
    )


def near_overpass(insitu: DataFrame, satellite: DataFrame, hours: float = 1.5) -> DataFrame:
    """Samples taken within `hours` of the overpass of their date's scene.

    The satellite side has one row per date: broadcast when counted small, otherwise repeated per salt
    so that a day with very many samples is spread over tasks.
    """
    passes = satellite.where("valid_final").select("reservoir_id", "date", "overpass_hour_utc")
    near = F.abs(temporal.fractional_hour(F.col("ts")) - F.col("overpass_hour_utc")) <= float(hours)
    return lookup_join(insitu, passes, ["reservoir_id", "date"], ["ts", "value"], near)


def nearest_in_time(
    rows: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    event_ts: str,
    within_seconds: int,
    carry: Sequence[str] = (),
    salts: int = 8,
) -> DataFrame:
    """`rows` with the nearest event of the same keys at most `within_seconds` away, before or after, across midnight.

    Adds `event_ts`, the `carry` columns and `seconds_away` (event minus row); rows without such an event are left out, of
    two events equally far the earlier counts, of two at one time the one with the smaller `carry` values. Null keys and
    times match nothing.

    Both sides are put on one time line and cut into buckets of that many seconds. Inside a bucket, ordered by time, a row
    takes the last event before and the first one after it. Events beyond the neighbouring buckets are too far away, and of
    those only the nearest edge matters, so each bucket lends its first and last event to its neighbours. No range join
    takes place, and rows of a crowded bucket are spread over `salts` tasks, each with the bucket's few events.
    """
    width = F.lit(int(within_seconds))
    seconds = lambda c: F.unix_micros(F.col(c)) / F.lit(1e6)
    bucket = lambda c: F.floor(seconds(c) / width)
    event = F.struct(F.col(event_ts).cast("timestamp").alias("at"), *carry).alias("event")
    named = lambda df, time: df.na.drop(subset=[*keys, time])
    known = named(events, event_ts).select(*keys, bucket(event_ts).alias("_bucket"), event).dropDuplicates()
    edges = known.groupBy(*keys, "_bucket").agg(F.min("event").alias("first"), F.max("event").alias("last"))
    lent = edges.select(*keys, (F.col("_bucket") - 1).alias("_bucket"), F.col("first").alias("event")).unionByName(
        edges.select(*keys, (F.col("_bucket") + 1).alias("_bucket"), F.col("last").alias("event"))
    )
    spread = known.unionByName(lent).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    given = named(rows, ts).select(
        *keys, bucket(ts).alias("_bucket"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int").alias("_salt"),
        F.col(ts).cast("timestamp").alias("_at"), F.struct(*rows.columns).alias("_row"),
    )
    line = spread.withColumn("_at", F.col("event.at")).unionByName(given, allowMissingColumns=True)
    place = Window.partitionBy(*keys, "_bucket", "_salt")
    # At one time, events come first on the way up and on the way down, so a row meets those of its own time both ways.
    before = F.last("event", True).over(place.orderBy("_at", F.col("_row").isNotNull(), F.col("event").desc()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("event", True).over(place.orderBy(F.col("_at").desc(), F.col("_row").isNotNull(), F.col("event").desc()).rowsBetween(Window.unboundedPreceding, 0))
    met = line.withColumns({"_before": before, "_after": after}).where("_row is not null")
    far = lambda c: F.abs(F.unix_micros(F.col(f"{c}.at")) - F.unix_micros("_at"))
    nearer_after = F.col("_before").isNull() | (far("_after") < far("_before"))
    chosen = met.withColumn("_event", F.when(nearer_after, F.col("_after")).otherwise(F.col("_before")))
    away = (F.unix_micros("_event.at") - F.unix_micros("_at")) / F.lit(1e6)
    near = chosen.withColumn("seconds_away", away).where(F.abs("seconds_away") <= width)
    return near.select("_row.*", F.col("_event.at").alias(event_ts), *[F.col(f"_event.{c}").alias(c) for c in carry], "seconds_away")


def daily_statistics(samples: DataFrame, keys: Sequence[str] = ("reservoir_id", "date", "variable")) -> DataFrame:
    """Mean, exact median, smallest, largest and count per group."""
    return grouped_distribution(samples, keys, "value", {"value_median": 0.5})


def match_overpass(insitu: DataFrame, satellite: DataFrame, hours: float = 1.5) -> DataFrame:
    """Daily statistics of the samples near the overpass."""
    near = near_overpass(insitu, satellite, hours)
    return daily_statistics(near, ("reservoir_id", "date", "variable", "overpass_hour_utc"))


def calibration_rows(
    daily: DataFrame, satellite: DataFrame, predictors: Sequence[str], min_rows: int = 6
) -> DataFrame:
    """Field mean and predictors per (reservoir, variable, date); groups with too few rows are marked."""
    joined = daily.select("reservoir_id", "date", "variable", F.col("value_mean").alias("y_true")).join(
        satellite.select("reservoir_id", "date", *predictors), ["reservoir_id", "date"]
    )
    complete = cut_lineage(joined.na.drop(subset=["y_true", *predictors]))
    sizes = complete.groupBy("reservoir_id", "variable").agg(F.count(F.lit(1)).alias("n_rows"))
    gated = complete.join(sizes, ["reservoir_id", "variable"])
    return gated.withColumn(
        "gate", F.when(F.col("n_rows") < min_rows, F.lit("too few matched rows")).otherwise(F.lit("ok"))
    )


def shared_dates(insitu: DataFrame, satellite: DataFrame) -> DataFrame:
    """Dates present on both sides."""
    return insitu.select("reservoir_id", "date").intersect(
        satellite.where("valid_final").select("reservoir_id", "date")
    )
