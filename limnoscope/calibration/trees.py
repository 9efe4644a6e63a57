"""Forest and boosting models, trained by MLlib over distributed rows.

One call fits one calibration, as many rows as it has; rows of several reservoirs may be pooled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from math import isnan
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from limnoscope.calibration.linear import score_aggregates
from limnoscope.calibration.splits import HELD_OUT
from limnoscope.operators.reshape import union_all

SEED = 42
MIN_ROWS = 18
# Deepest tree MLlib grows: "no limit" cannot be given, so trees of more than 30 levels stop there.
UNLIMITED_DEPTH = 30

# Parameter grids of the tree models.
FOREST_GRID = {
    "numTrees": (100, 300),
    "maxDepth": (UNLIMITED_DEPTH, 3, 5, 8),
    "minInstancesPerNode": (1, 2, 4),
}
BOOSTING_GRID = {"maxIter": (100, 300), "stepSize": (0.01, 0.05, 0.1), "maxDepth": (2, 3, 4)}


def _estimators():
    common = dict(featuresCol="features", labelCol="y_true", predictionCol="y_pred", seed=SEED)
    return {
        # Every split may use every predictor.
        "random_forest": (6, RandomForestRegressor(featureSubsetStrategy="all", **common), FOREST_GRID),
        "gradient_boosting": (7, GBTRegressor(featureSubsetStrategy="all", **common), BOOSTING_GRID),
    }


def _with(estimator, setting: Mapping):
    return estimator.copy({estimator.getParam(p): v for p, v in setting.items()})


def _fold_predictions(estimator, setting: Mapping, train: DataFrame, fold: int, scheme: str) -> DataFrame:
    """Rows of one fold, predicted by a model that saw the other folds, or only the earlier ones of a time series."""
    others = F.col("part") < fold if scheme == "timeseries" else F.col("part") != fold
    return _with(estimator, setting).fit(train.where(others)).transform(train.where(F.col("part") == fold)).select("part", "y_true", "y_pred")


def _mean_score(estimator, setting: Mapping, train: DataFrame, folds: Sequence[int], scheme: str) -> float:
    """Mean R2 over the folds; only the scores come back to the driver, models are dropped."""
    judge = RegressionEvaluator(labelCol="y_true", predictionCol="y_pred", metricName="r2")
    scores = [judge.evaluate(_fold_predictions(estimator, setting, train, f, scheme)) for f in folds]
    return sum(scores) / len(scores) if scores else float("nan")


def fit_tree_models(
    rows: DataFrame,
    predictors: Sequence[str],
    models: Sequence[str] = ("random_forest", "gradient_boosting"),
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    parallelism: int = 4,
    scheme: str = "kfold",
) -> tuple[DataFrame, DataFrame, dict]:
    """(metrics, predictions, models refitted on all rows) for rows that carry `part`.

    `part` holds the fold of a train row and a negative number for held-out and outlier rows. With the scheme
    `timeseries`, parts are blocks in time order: each block after the first is predicted from the blocks before it.
    """
    n_rows = rows.count()
    if n_rows < MIN_ROWS:
        raise ValueError(f"tree models need {MIN_ROWS} rows, got {n_rows}")
    data = VectorAssembler(inputCols=list(predictors), outputCol="features").transform(rows)
    train = data.where(F.col("part") >= 0)
    last = train.agg(F.max("part")).first()[0]
    folds = range(1 if scheme == "timeseries" else 0, (last or 0) + 1)
    metrics, predictions, refitted = [], [], {}
    for name in models:
        position, estimator, grid = _estimators()[name]
        grid = dict((grids or {}).get(name, grid))
        settings = [dict(zip(grid, values)) for values in product(*grid.values())]
        with ThreadPool(parallelism) as pool:
            scores = pool.map(lambda at: _mean_score(estimator, at, train, folds, scheme), settings)
        # A setting without a score comes after all others.
        best = max(range(len(settings)), key=lambda i: (not isnan(scores[i]), 0.0 if isnan(scores[i]) else scores[i], -i))
        chosen = settings[best]
        by_fold = union_all([_fold_predictions(estimator, chosen, train, f, scheme) for f in folds])
        final = _with(estimator, chosen).fit(train)
        cv = by_fold.groupBy("part").agg(*score_aggregates()).agg(
            *[
                f(m).alias(f"cv_{m}_{label}")
                for m in ("r2", "rmse", "mae")
                for label, f in (("mean", F.avg), ("std", F.stddev_pop))
            ]
        )
        scored = union_all(
            [
                final.transform(data.where(F.col("part") >= 0)).withColumn("set", F.lit("train")),
                final.transform(data.where(F.col("part") == HELD_OUT)).withColumn("set", F.lit("test")),
            ]
        )
        pick = lambda s, m: F.max(F.when(F.col("set") == s, F.col(m))).alias(f"{s}_{m}")
        sets = scored.groupBy("set").agg(*score_aggregates()).agg(
            *[pick(s, m) for s in ("train", "test") for m in ("r2", "rmse", "mae")]
        )
        label = {"model_name": F.lit(name), "position": F.lit(position), "best_params": F.to_json(
            F.create_map(*[c for k, v in chosen.items() for c in (F.lit(k), F.lit(float(v)))])
        )}
        # Both sides hold one row.
        metrics.append(cv.withColumn("k", F.lit(1)).join(sets.withColumn("k", F.lit(1)), "k").drop("k").withColumns(label))
        keep = [c for c in rows.columns if c not in predictors and c != "part"]
        predictions.append(
            scored.select(*keep, "set", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual")).withColumn(
                "model_name", F.lit(name)
            )
        )
        refitted[name] = _with(estimator, chosen).fit(data)
    return union_all(metrics), union_all(predictions), refitted
