import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnoscope.calibration import config, linear, splits, trees
from limnoscope.plans import calibration as plan
from limnoscope.schemas import PIXEL

PREDICTORS = ["a", "b", "c"]


def table(n=60, seed=0, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.02] + [2.0, -3.0, 0.1]
    y = 3.0 + 2.0 * x[:, 0] - 0.5 * x[:, 1] + 40.0 * x[:, 2] + rng.normal(size=n) * noise
    return x, y


def frame(spark, x, y, variable="pc"):
    start = dt.date(2020, 1, 1)
    rows = [(1, variable, start + dt.timedelta(days=3 * i), float(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "reservoir_id int, variable string, date date, y_true double, a double, b double, c double")


def all_fits(spark, x, y, models):
    rows = frame(spark, x, y).withColumn("part", F.lit(0))
    chosen = linear.chosen_models(models)
    designs = linear.with_designs(rows, PREDICTORS, [m.degree for m in chosen], ["reservoir_id", "variable", "date", "y_true", "part"])
    fits = linear.fit_models(linear.product_sums(designs), chosen).where("fit = 'all'").collect()
    return {(f["model_name"], f["candidate"]): f for f in fits}


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def expand(x, degree):
    from itertools import combinations_with_replacement

    return np.column_stack([np.prod(x[:, list(t)], axis=1) for d in range(1, degree + 1) for t in combinations_with_replacement(range(3), d)])


def test_linear_and_ridge_against_numpy(spark):
    x, y = table()
    fits = all_fits(spark, x, y, ["linear", "ridge", "poly2", "poly3"])
    line = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    assert fits["linear", 0]["intercept"] == pytest.approx(line[0])
    assert fits["linear", 0]["coefficients"] == pytest.approx(line[1:])
    for k, alpha in enumerate((0.01, 0.1, 1.0, 10.0, 100.0)):
        z = scaled(x)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
        got = fits["ridge", k]
        assert got["intercept"] + x @ got["coefficients"] == pytest.approx(y.mean() + z @ w, rel=1e-8)
    x2 = expand(x, 2)
    full = np.column_stack([np.ones(len(y)), x2])
    assert fits["poly2", 0]["intercept"] + x2 @ fits["poly2", 0]["coefficients"] == pytest.approx(
        full @ np.linalg.lstsq(full, y, rcond=None)[0], rel=1e-5
    )
    x3 = expand(x, 3)
    z = scaled(x3)
    w = np.linalg.solve(z.T @ z + 1.0 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    got = fits["poly3", 2]
    assert got["intercept"] + x3 @ got["coefficients"] == pytest.approx(y.mean() + z @ w, rel=1e-5)


def test_penalised_fits_meet_the_optimality_conditions(spark):
    x, y = table(seed=4, noise=2.0)
    x[:, 1] = x[:, 0] * 5 + 0.05 * x[:, 1]  # strongly related predictors
    fits = all_fits(spark, x, y, ["lasso", "elastic_net"])
    z, centred = scaled(x), y - y.mean()
    for (name, _), f in fits.items():
        w = np.array(f["coefficients"]) * x.std(0)
        slope = z.T @ (centred - z @ w) / len(y) - f["alpha"] * (1 - f["l1_ratio"]) * w
        l1 = f["alpha"] * f["l1_ratio"]
        for s, v in zip(slope, w):
            assert (abs(s - l1 * np.sign(v)) < 1e-7) if abs(v) > 1e-12 else (abs(s) <= l1 + 1e-7), name


def test_constant_and_repeated_predictors(spark):
    x, y = table()
    x[:, 1], x[:, 2] = 7.0, x[:, 0]
    for f in all_fits(spark, x, y, ["linear", "ridge", "lasso"]).values():
        assert np.all(np.isfinite(f["coefficients"])) and np.isfinite(f["intercept"])
        fitted = f["intercept"] + x @ f["coefficients"]
        if f["alpha"] <= 0.01:
            best = np.polyval(np.polyfit(x[:, 0], y, 1), x[:, 0])
            assert np.abs(fitted - best).max() < 0.05


def test_split_sizes_and_folds(spark):
    x, y = table(31)
    small = frame(spark, x[:7], y[:7], "small")
    parts = splits.assign_parts(frame(spark, x, y).unionByName(small), remove_outliers=False)
    got = {(r["variable"], r["part"]): r["count"] for r in parts.groupBy("variable", "part").count().collect()}
    assert got["pc", -1] == 8 and got["small", -1] == 2
    assert sorted(got["pc", p] for p in range(5)) == [4, 4, 5, 5, 5]
    assert sum(got.values()) == 38
    again = splits.assign_parts(frame(spark, x, y).unionByName(small).repartition(7), remove_outliers=False)
    assert parts.select("variable", "date", "part").exceptAll(again.select("variable", "date", "part")).count() == 0


def test_time_blocks(spark):
    x, y = table(23)
    blocks = splits.time_blocks(frame(spark, x, y)).orderBy("date").collect()
    numbers = [b["block"] for b in blocks]
    assert numbers == [0] * 8 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3


def test_outliers_leave_the_train_rows_only(spark):
    x, y = table(40)
    y[:] = 1.0 + np.arange(40) * 0.01
    y[[3, 17, 29]] = 500.0
    split = splits.mark_outliers(splits.holdout_split(frame(spark, x, y)))
    got = {(r["split"], r["big"]): r["count"] for r in split.groupBy("split", (F.col("y_true") > 100).alias("big")).count().collect()}
    assert got.get(("train", True), 0) == 0 and got.get(("outlier", True), 0) + got.get(("test", True), 0) == 3
    assert ("outlier", False) not in got


def test_calibration_against_numpy(spark):
    """Scores, choice and refit of one group recomputed from the same parts."""
    x, y = table(70, seed=2, noise=1.0)
    result = plan.calibrate(frame(spark, x, y), PREDICTORS, ["linear", "ridge", "lasso"])
    rows = result.rows.orderBy("date").collect()
    part = np.array([r["part"] for r in rows])
    scores = []
    for f in range(5):
        tr, te = (part >= 0) & (part != f), part == f
        w = np.linalg.lstsq(np.column_stack([np.ones(tr.sum()), x[tr]]), y[tr], rcond=None)[0]
        err = y[te] - w[0] - x[te] @ w[1:]
        scores.append((1 - (err**2).sum() / ((y[te] - y[te].mean()) ** 2).sum(), np.sqrt((err**2).mean()), np.abs(err).mean()))
    metrics = {m["model_name"]: m for m in result.metrics.collect()}
    got = metrics["linear"]
    for i, name in enumerate(("r2", "rmse", "mae")):
        assert got[f"cv_{name}_mean"] == pytest.approx(np.mean([s[i] for s in scores]))
        assert got[f"cv_{name}_std"] == pytest.approx(np.std([s[i] for s in scores]))
    assert got["test_samples"] == 18 and got["n_samples_after_merge"] == 70
    best = result.best.first()
    assert best["cv_r2_mean"] == max(m["cv_r2_mean"] for m in metrics.values())
    assert best["cv_r2_mean"] > 0.8 and json.loads(best["best_params"]).keys() == {"alpha", "l1_ratio"}
    sets = {r["set"]: r["count"] for r in result.predictions.where("model_name = 'linear'").groupBy("set").count().collect()}
    assert sets["test"] == 18
    (conf,) = plan.configurations(result, PREDICTORS).collect()
    assert conf["available"] and conf["band_name"] == "Calibrated_pc" and conf["predictor_set"] == PREDICTORS
    assert conf["fill_values"] == pytest.approx(np.median(x, axis=0))
    fitted = conf["intercept"] + x @ conf["coefficients"]
    assert 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.8


def test_polynomials_give_no_band(spark):
    x, y = table(40)
    result = plan.calibrate(frame(spark, x, y), PREDICTORS, ["poly2"], scheme="timeseries")
    (conf,) = plan.configurations(result, PREDICTORS).collect()
    assert not conf["available"] and conf["coefficients"] is None and "poly2" in conf["reason"]
    assert {r["part"] for r in result.scores.collect()} == {1, 2, 3, 4, 5}


def test_first_model_wins_a_tie_and_missing_scores_never_win(spark):
    metrics = spark.createDataFrame(
        [(1, "v", "poly2", 4, None), (1, "v", "ridge", 1, 0.5), (1, "v", "linear", 0, 0.5), (2, "v", "linear", 0, None)],
        "reservoir_id int, variable string, model_name string, position int, cv_r2_mean double",
    )
    assert [(r["reservoir_id"], r["model_name"]) for r in linear.best_model(metrics).collect()] == [(1, "linear")]


def test_scores_of_degenerate_sets(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "y_true double, y_pred double").agg(*linear.score_aggregates()).first()
    assert one["r2"] is None and one["rmse"] == 1.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y_true double, y_pred double").agg(*linear.score_aggregates()).first()
    assert flat["r2"] is None and flat["mae"] == 0.5


def test_impute_and_standardise(spark):
    x, y = table(5)
    rows = frame(spark, x, y).withColumn("a", F.when(F.col("date") > "2020-01-02", F.col("a")))
    filled = config.impute_medians(rows, PREDICTORS).orderBy("date").collect()
    assert filled[0]["a"] == pytest.approx(np.median(x[1:, 0]))
    flat = frame(spark, x, y).withColumn("b", F.lit(4.0))
    got = np.array([[r["a"], r["b"]] for r in config.standardise(flat, ["a", "b"]).orderBy("date").collect()])
    assert got[:, 0] == pytest.approx(scaled(x)[:, 0]) and np.all(got[:, 1] == 0)


def test_calibrated_band(spark):
    ts = dt.datetime(2024, 5, 1, 10)
    rows = [
        (i, r, ts.date(), 0, ts, 0.0, 0.0, 400.0, 300.0, b4, 900.0, 800.0, 700.0, 500.0, scl, 0, 10.0)
        for i, (r, b4, scl) in enumerate([(1, 500.0, 6), (1, None, 6), (1, 500.0, 9), (2, 500.0, 6)])
    ]
    conf = spark.createDataFrame(
        [(1, True, 1.0, [2.0, -1000.0], [0.25, 0.0])],
        "reservoir_id int, available boolean, intercept double, coefficients array<double>, fill_values array<double>",
    )
    got = config.calibrated_band(spark.createDataFrame(rows, PIXEL), conf, ["R705_R665", "TB_740"]).orderBy("pixel_id").collect()
    assert [r["calibrated"] for r in got] == pytest.approx([1 + 2 * 1.8 + 10, 1 + 2 * 0.25 + 10, None, None])


def test_trees(spark):
    x, y = table(40, noise=0.1)
    parts = splits.assign_parts(frame(spark, x, y), folds=3)
    grids = {
        "random_forest": {"numTrees": (5,), "maxDepth": (3, 5), "minInstancesPerNode": (1,)},
        "gradient_boosting": {"maxIter": (5,), "stepSize": (0.3,), "maxDepth": (2,)},
    }
    metrics, predictions, refitted = trees.fit_tree_models(parts, PREDICTORS, grids=grids)
    got = {m["model_name"]: m for m in metrics.collect()}
    assert set(got) == set(refitted) == {"random_forest", "gradient_boosting"}
    assert all(m["train_r2"] > 0.5 and m["cv_rmse_mean"] > 0 for m in got.values())
    assert {r["set"] for r in predictions.select("set").distinct().collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        trees.fit_tree_models(parts.limit(5), PREDICTORS)
    grid = trees.FOREST_GRID
    assert len(grid["numTrees"]) * len(grid["maxDepth"]) * len(grid["minInstancesPerNode"]) == 24


def test_bundle(spark, tmp_path):
    from limnoscope.sources.files import read_configs

    x, y = table(40)
    y[5] = 900.0
    result = plan.calibrate(frame(spark, x, y), PREDICTORS, ["linear", "ridge"])
    path = str(tmp_path / "bundle")
    plan.write_bundle(result, PREDICTORS, path)
    (conf,) = read_configs(spark, f"{path}/configuration").collect()
    (direct,) = plan.configurations(result, PREDICTORS).collect()
    assert conf["coefficients"] == direct["coefficients"] and conf["available"]
    assert spark.read.option("header", True).csv(f"{path}/metrics").count() == 2
    configs = plan.configurations(result, PREDICTORS)
    text = configs.select(config.config_json(configs).alias("j")).first()["j"]
    assert json.loads(text)["band_name"] == "Calibrated_pc"


def test_offered_models(spark):
    x, y = table(20)
    rows = frame(spark, x, y).unionByName(frame(spark, x[:8], y[:8], "few"))
    got = {(r["variable"], r["model_name"]) for r in config.offered_models(rows, ["linear", "random_forest", "nope"]).collect()}
    assert got == {("pc", "linear"), ("pc", "random_forest"), ("few", "linear")}
