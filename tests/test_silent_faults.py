"""Faults that once gave wrong rows without a word: each stays an error or a right result."""

import pytest
from pyspark.sql import functions as F

from limnoscope.calibration import config
from limnoscope.operators import sensors, sizing, spatial, tables
from limnoscope.sources import files


def test_bands_of_several_variables_keep_every_pixel_once(spark):
    names = ["MCI_705"]
    rows = [(1, "chl", True, names, 1.0, [0.0], [0.0]), (1, "pc", True, names, 2.0, [0.0], [0.0])]
    conf = spark.createDataFrame(
        rows, "reservoir_id int, variable string, available boolean, predictor_set array<string>, intercept double, coefficients array<double>, fill_values array<double>"
    )
    bands = {b: 500.0 for b in ("b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8", "b8a")}
    pixels = spark.range(5).select(F.lit(1).alias("reservoir_id"), F.col("id").alias("pixel_id"), F.lit(6).alias("scl"), *[F.lit(v).alias(b) for b, v in bands.items()])
    got = config.calibrated_bands(pixels, conf, names, {"a": "chl", "b": "pc", "c": "none"}).collect()
    assert len(got) == 5 and {(r.a, r.b, r.c) for r in got} == {(1.0, 2.0, None)}
    with pytest.raises(Exception, match="several configurations"):
        config.calibrated_band(pixels, conf, names).collect()


def test_predictors_follow_the_configuration(spark):
    conf = spark.createDataFrame(
        [(1, True, ["MCI_705", "TB_740"], 0.0, [0.0, 1.0], [5.0, 7.0])],
        "reservoir_id int, available boolean, predictor_set array<string>, intercept double, coefficients array<double>, fill_values array<double>",
    )
    bands = {b: None for b in ("b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8", "b8a")}
    pixels = spark.range(1).select(F.lit(1).alias("reservoir_id"), F.col("id").alias("pixel_id"), F.lit(6).alias("scl"), *[F.lit(v).cast("double").alias(b) for b, v in bands.items()])
    assert config.calibrated_band(pixels, conf, ["TB_740", "MCI_705"]).first().calibrated == 7.0


def test_null_keys_are_a_group(spark):
    rows = spark.createDataFrame([(None, k) for k in range(5)] + [("a", k) for k in range(5)], "g string, v int")
    got = sizing.spread_row_number(rows, ["g"], F.col("v") % 2, ["v"], "n", total="size").collect()
    assert sorted((r.g or "", r.n, r["size"]) for r in got) == [(g, n, 5) for g in ("", "a") for n in range(1, 6)]


def test_clip_off_the_grid(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (50.0, 40.0), (0.0, 100.0), (0.0, 0.0)]
    aoi = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])] * 2, "reservoir_id int, ring array<struct<x:double,y:double>>")
    places = [(x * 20 + 10.0, y * 20 + o) for x in range(-1, 6) for y in range(-1, 6) for o in (0.0, 10.0)]
    pixels = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(places)], "reservoir_id int, pixel_id int, x double, y double")

    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    got = [r.pixel_id for r in spatial.clip_to_aoi(pixels, aoi).collect()]
    assert sorted(got) == [k for k, (x, y) in enumerate(places) if inside(x, y)]


def test_repeated_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id int, v string, at int")
    assert {(r.id, r.v) for r in tables.update_rows(table, changes, "id", order="at").collect()} == {(1, "y"), (2, "b")}
    with pytest.raises(Exception, match="several changes"):
        tables.update_rows(table, changes.drop("at"), "id").collect()


def test_repeated_readings_never_mix(spark):
    rows = [("s", 1, 7, "a", None), ("s", 1, 7, None, "b")]
    df = spark.createDataFrame(rows, "sensor string, t int, ingest_id int, p string, q string")
    (one,) = sensors.drop_repeated(df, ["sensor", "t"]).collect()
    assert (one.p, one.q) in (("a", None), (None, "b"))


def test_uploads_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,time,pc,chl\n2024-01-02,10:00,1,2\n")
    (tmp_path / "b.csv").write_text("date,time,chl,pc\n2024-01-03,10:00,3,4\n")
    got = {(str(r.ts)[:10], r.variable): r.value for r in files.read_insitu_uploads(spark, str(tmp_path)).collect()}
    assert got == {("2024-01-02", "pc"): 1.0, ("2024-01-02", "chl"): 2.0, ("2024-01-03", "chl"): 3.0, ("2024-01-03", "pc"): 4.0}


def test_tree_folds_of_a_time_series_see_the_past_only(spark):
    """Blocks with levels of their own: the first later block can only be predicted at the first block's level."""
    from limnoscope.calibration import trees

    rows = [(f"d{p}{k}", float(100 * p), float(k % 3), p) for p in range(3) for k in range(8)]
    data = spark.createDataFrame(rows, "date string, y_true double, v double, part int")
    estimator = trees.RandomForestRegressor(featuresCol="features", labelCol="y_true", predictionCol="y_pred", numTrees=3, seed=1)
    train = trees.VectorAssembler(inputCols=["v"], outputCol="features").transform(data)
    past = trees._fold_predictions(estimator, {"maxDepth": 2}, train, 1, "timeseries").collect()
    assert {r.y_pred for r in past} == {0.0}
    mixed = trees._fold_predictions(estimator, {"maxDepth": 2}, train, 1, "kfold").collect()
    assert min(r.y_pred for r in mixed) > 10.0
