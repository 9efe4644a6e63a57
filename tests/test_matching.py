import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnoscope.functions.temporal import combined_timestamp
from limnoscope.operators import matching, sizing


def scene(day, tile=0, cloud=10, coverage=95.0, hour=10, value=1.0):
    d = dt.date(2024, 5, day)
    return (1, d, tile, dt.datetime(2024, 5, day, hour, 50), cloud, coverage, value)


def scenes(spark, rows):
    return spark.createDataFrame(
        rows, "reservoir_id int, scene_date date, tile int, scene_ts timestamp, cloud_meta long, coverage_area_pct double, p double"
    )


def chosen(spark, rows, day=10, **options):
    dates = spark.createDataFrame([(1, dt.date(2024, 5, day))], "reservoir_id int, date date")
    return matching.match_scenes(dates, scenes(spark, rows), predictors=["p"], **options).collect()


@pytest.mark.parametrize(
    "rows, want",
    [
        ([scene(8), scene(11), scene(13)], (11, 0)),  # nearest
        ([scene(10, coverage=10.0), scene(12)], (12, 0)),  # valid first
        ([scene(9, cloud=5), scene(11, cloud=4)], (11, 0)),  # equally near: clearer
        ([scene(9, coverage=91.0), scene(11, coverage=92.0)], (11, 0)),  # then more coverage
        ([scene(9), scene(11)], (9, 0)),  # then earlier
        ([scene(10, tile=1, cloud=1), scene(10, tile=0, cloud=2)], (10, 1)),
        ([scene(6), scene(14)], None),  # outside the window
        ([scene(10, cloud=99)], None),
    ],
)
def test_best_scene(spark, rows, want):
    got = chosen(spark, rows, min_coverage=50)
    assert [(r["sentinel_date"].day, r["tile"]) for r in got] == ([want] if want else [])


def test_invalid_scene_has_no_predictors(spark):
    (row,) = chosen(spark, [scene(10, coverage=10.0)])
    assert row["valid_final"] is False and row["p"] is None and row["n_candidates"] == 1
    (row,) = chosen(spark, [scene(9), scene(10), scene(10, tile=1)])
    assert row["n_candidates"] == 3 and row["p"] == 1.0 and row["days_from_insitu"] == 0


@pytest.mark.parametrize("max_rows", [sizing.BROADCAST_ROWS, 0])
def test_overpass_statistics(spark, monkeypatch, max_rows):
    def join(*args, **kwargs):
        return sizing.lookup_join(*args, **kwargs, max_rows=max_rows)

    monkeypatch.setattr(matching, "lookup_join", join)
    satellite = matching.match_scenes(
        spark.createDataFrame([(1, dt.date(2024, 5, 10))], "reservoir_id int, date date"), scenes(spark, [scene(10)])
    )
    at = lambda h, m, v: (1, dt.date(2024, 5, 10), dt.datetime(2024, 5, 10, h, m), "pc", v)
    insitu = spark.createDataFrame(
        [at(9, 20, 1.0), at(10, 0, 2.0), at(12, 20, 6.0), at(12, 21, 100.0), at(9, 19, 100.0)],
        "reservoir_id int, date date, ts timestamp, variable string, value double",
    )
    (row,) = matching.match_overpass(insitu, satellite, 1.5).collect()
    assert (row["n_obs"], row["value_mean"], row["value_median"], row["value_min"], row["value_max"]) == (3, 3.0, 2.0, 1.0, 6.0)


def test_prepare(spark):
    raw = spark.createDataFrame(
        [(1, "2024-05-10", "10:20", "1.5"), (1, "2024-05-10", "16:00", "2"), (1, "bad", "10:00", "2"), (1, "2024-05-10", "11:00", "x")],
        "reservoir_id int, date string, time string, v string",
    )
    got = matching.prepare_insitu(raw, combined_timestamp(F.col("date"), F.col("time")), F.col("v"), F.lit("pc"), 8, 15)
    assert [(r["value"], str(r["date"]), r["time"]) for r in got.collect()] == [(1.5, "2024-05-10", "10:20:00")]


def test_gate(spark):
    sat = spark.createDataFrame([(1, dt.date(2024, 5, d), float(d)) for d in range(1, 8)], "reservoir_id int, date date, p double")
    daily = spark.createDataFrame(
        [(1, dt.date(2024, 5, d), "a", 1.0) for d in range(1, 8)] + [(1, dt.date(2024, 5, 1), "b", 1.0)],
        "reservoir_id int, date date, variable string, value_mean double",
    )
    gates = {r["variable"]: r["gate"] for r in matching.calibration_rows(daily, sat, ["p"]).collect()}
    assert gates == {"a": "ok", "b": "too few matched rows"}


def test_pixels_around_prunes_before_aggregation(spark):
    pixels = spark.createDataFrame(
        [(1, dt.date(2024, 5, d), c) for d in range(1, 21) for c in (10, 90)], "reservoir_id int, scene_date date, cloud_meta long"
    )
    dates = spark.createDataFrame([(1, dt.date(2024, 5, 10))], "reservoir_id int, date date")
    kept = matching.pixels_around(pixels, dates, 3, 60).collect()
    assert sorted(r["scene_date"].day for r in kept) == list(range(7, 14))
