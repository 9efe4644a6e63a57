import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnoscope.operators import reduction, reshape, screening
from limnoscope.schemas import PIXEL

D1, D2 = dt.date(2018, 5, 1), dt.date(2019, 5, 1)


def pixels(spark, rows):
    """rows: (date, tile, scl, cldprb, b4, b5)"""
    full = []
    for i, (day, tile, scl, prob, b4, b5) in enumerate(rows):
        ts = dt.datetime(day.year, day.month, day.day, 10, 50 + tile)
        full.append((i, 1, day, tile, ts, 20.0 * i, 0.0, 400.0, 300.0, b4, b5, 800.0, 700.0, 500.0, scl, prob, 10.0))
    return spark.createDataFrame(full, PIXEL)


def test_cloud_share(spark):
    rows = [(D1, 0, 8, 50, 500.0, 900.0), (D1, 0, 6, 0, None, 900.0), (D1, 0, 6, 20, 500.0, 900.0), (D1, 0, 4, 99, 500.0, 1.0)]
    got = screening.scene_statistics(pixels(spark, rows)).first()
    assert got["cloud_pct"] == pytest.approx(100 * (0.95 / 3 + 0.05 * 2 / 3))
    assert got["coverage_count_pct"] == 75.0 and got["coverage_area_pct"] == 75.0 and got["n_pixels"] == 4


def test_one_share_missing(spark):
    no_probability = screening.scene_statistics(pixels(spark, [(D1, 0, 8, None, 1.0, 1.0), (D1, 0, 6, None, 1.0, 1.0)])).first()
    assert no_probability["cloud_pct"] == 50.0
    only_land = screening.scene_statistics(pixels(spark, [(D1, 0, 4, 0, 1.0, 1.0)]))
    assert only_land.first()["cloud_pct"] is None
    assert only_land.where(screening.passes(100, 0)).count() == 0


def test_thresholds_and_best_scene(spark):
    rows = []
    for tile, clouds in ((0, 2), (1, 1), (2, 1)):
        rows += [(D1, tile, 9 if i < clouds else 6, 0, 500.0, 900.0) for i in range(4)]
    scenes = screening.scene_statistics(pixels(spark, rows))
    best = screening.best_scene_per_date(scenes, 60, 50).collect()
    assert [b["tile"] for b in best] == [1]
    assert screening.valid_dates(scenes, 60, 50).count() == 1
    assert screening.valid_dates(scenes, 10, 50).count() == 0
    assert screening.valid_dates(scenes, 100, 50).first()["cloud_pct"] == pytest.approx(47.5)


def test_means_ignore_masked_pixels_and_use_dark_water_once(spark):
    base = [(D1, 0, 6, 0, 500.0, 900.0), (D1, 0, 2, 0, 500.0, 700.0), (D2, 0, 6, 0, 500.0, 900.0), (D2, 0, 2, 0, 500.0, 700.0)]
    noise = [(D1, 0, 6, 0, None, 900.0), (D2, 0, 4, 0, 500.0, 5000.0)]
    means = {}
    for rows in (base, base + noise):
        got = reduction.reservoir_daily_means(pixels(spark, rows), ["PCI_B5/B4"], 100, 0)
        means[len(rows)] = {r["scene_date"]: r["PCI_B5/B4"] for r in got.collect()}
    assert means[4] == means[6]
    assert means[4][D1] == pytest.approx(1.6) and means[4][D2] == pytest.approx(1.8)


def test_classes(spark):
    rows = [(D2, 0, 6, 0, 500.0, b5) for b5 in (500.0, 600.0, 760.0, 1010.0, 2000.0)] + [(D2, 0, 9, 0, 500.0, 600.0)]
    got = reduction.area_by_class(pixels(spark, rows), "PCI_B5/B4", [1.0, 1.5, 2.0, 3.0]).orderBy("class_no").collect()
    assert [r["area_ha"] for r in got] == pytest.approx([0.08, 0.04, 0.04])
    assert [r["percent"] for r in got] == pytest.approx([40.0, 20.0, 20.0])
    assert got[0]["range"] == "1.0–1.5"
    empty = reduction.area_by_class(pixels(spark, [(D2, 0, 9, 0, 1.0, 1.0)]), "PCI_B5/B4", [0.0, 1.0]).first()
    assert (empty["area_ha"], empty["percent"]) == (0.0, 0.0)


def test_one_shuffle_of_pixels(spark):
    """Screening and means together move each scene's partial sums once."""
    means = reduction.reservoir_daily_means(pixels(spark, [(D2, 0, 6, 0, 500.0, 900.0)]), ["MCI"])
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(reservoir_id") == 2  # scenes, then dates
    assert "Join" not in plan


def test_result_tables(spark):
    table = spark.createDataFrame(
        [("Media_Embalse", "2024-01-01", "Valor Estimado", 1.0, None), ("Media_Embalse", "2024-01-01", "Valor Estimado", None, 2.0),
         ("P1", "2024-01-01", "Valor Estimado", 3.0, None), ("P1", "bad", "Valor Estimado", 3.0, None)],
        "location string, Date string, kind string, MCI double, NDCI double",
    )
    shown = reshape.with_reading_time(table, ["Fecha-hora", "Date"])
    assert shown.columns == ["ts", "location", "kind", "MCI", "NDCI"] and shown.count() == 3
    merged = reshape.collapse_means(shown, ["location", "ts", "kind"], ["MCI", "NDCI"])
    means, points = reshape.split_means(merged)
    assert means.count() == 1 and points.count() == 1
    assert (means.first()["MCI"], means.first()["NDCI"]) == (1.0, 2.0)
    with pytest.raises(ValueError):
        reshape.with_reading_time(table.drop("Date"), ["Date"])


def test_nested_points(spark):
    points = spark.createDataFrame([("R", "a", 1.0, 2.0), ("R", "b", 3.0, 4.0)], "reservoir string, point string, lat double, lon double")
    assert {k: tuple(v) for k, v in reshape.nest_points(points).first()["points"].items()} == {"a": (1.0, 2.0), "b": (3.0, 4.0)}
    again = points.unionByName(points.selectExpr("reservoir", "point", "lat + 1 as lat", "lon")).withColumn("n", F.col("lat"))
    assert tuple(reshape.nest_points(again, order="n").first()["points"]["a"]) == (2.0, 2.0)
