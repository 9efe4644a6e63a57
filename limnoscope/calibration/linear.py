"""Linear calibration models fitted from sums of products.

Rows never gather in one place: a grouped aggregation adds up the products of all pairs of features per
(group, feature design, fold). Those small matrices are all a fit needs, since the matrix of a training
set is the sum of the matrices of its folds. One `applyInPandas` solves them; predictions and scores are
DataFrame expressions over the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from limnoscope.calibration.splits import GROUP, HELD_OUT
from limnoscope.operators.sizing import lookup_join


@dataclass(frozen=True)
class LinearModel:
    name: str
    position: int
    degree: int
    scaled: bool
    penalty: str  # none, l2 or l1l2
    alphas: tuple[float, ...] = (0.0,)
    l1_ratios: tuple[float, ...] = (0.0,)
    min_rows: int = 0
    rasterizable: bool = False

    def grid(self) -> list[tuple[float, float]]:
        return [(a, r) for a in self.alphas for r in self.l1_ratios]


# The model catalogue and its parameter grids.
CATALOGUE = (
    LinearModel("linear", 0, 1, False, "none", rasterizable=True),
    LinearModel("ridge", 1, 1, True, "l2", (0.01, 0.1, 1.0, 10.0, 100.0), rasterizable=True),
    LinearModel("lasso", 2, 1, True, "l1l2", (0.001, 0.01, 0.1, 1.0), (1.0,), rasterizable=True),
    LinearModel("elastic_net", 3, 1, True, "l1l2", (0.001, 0.01, 0.1, 1.0), (0.2, 0.5, 0.8), rasterizable=True),
    LinearModel("poly2", 4, 2, True, "none"),
    LinearModel("poly3", 5, 3, True, "l2", (0.01, 0.1, 1.0, 10.0)),
)
MODEL_NAMES = tuple(m.name for m in CATALOGUE)
MAX_SWEEPS = 10_000


def chosen_models(names: Sequence[str]) -> list[LinearModel]:
    found = [m for m in CATALOGUE if m.name in names]
    if not found:
        raise ValueError(f"no valid model among {list(names)}")
    return found


def feature_terms(predictors: Sequence[str], degree: int) -> list[tuple[str, ...]]:
    """Products of up to `degree` predictors, lower degrees first."""
    return [t for d in range(1, degree + 1) for t in combinations_with_replacement(predictors, d)]


def _term(names: tuple[str, ...]) -> Column:
    value = F.col(names[0]).cast("double")
    for name in names[1:]:
        value = value * F.col(name)
    return value


def with_designs(rows: DataFrame, predictors: Sequence[str], degrees: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per (row, degree) with its features as the array `x`."""
    designs = [
        F.struct(F.lit(d).alias("degree"), F.array(*[_term(t) for t in feature_terms(predictors, d)]).alias("x"))
        for d in sorted(set(degrees))
    ]
    return rows.select(*keep, F.inline(F.array(*designs)))


def product_sums(designs: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Sums of z_i * z_j with z = (1, features, target), per (group, degree, part).

    Each Arrow batch is multiplied out at once and sends only its sums into the shuffle.
    """
    keys = [*group, "degree", "part"]
    schema = T.StructType(
        [designs.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("p", T.DoubleType())]
    )

    def multiply(batches):
        for batch in batches:
            for key, block in batch.groupby(keys, sort=False, dropna=False):
                x = np.stack(block["x"].to_list())
                z = np.column_stack([np.ones(len(x)), x, block["y_true"].to_numpy(float)])
                i, j = np.triu_indices(z.shape[1])
                sums = pd.DataFrame({"i": i, "j": j, "p": (z.T @ z)[i, j]})
                # Rows of a NULL key are a group like any other.
                named = {k: None if pd.isna(v) else v for k, v in zip(keys, key)}
                yield sums.assign(**named)[schema.names]

    partial = designs.select(*keys, "x", F.col("y_true").cast("double")).mapInPandas(multiply, schema)
    return partial.groupBy(*keys, "i", "j").agg(F.sum("p").alias("s"))


def solve_sums(sums: np.ndarray, model: LinearModel, alpha: float, l1_ratio: float):
    """(intercept, coefficients, mean, scale) of one training matrix; features enter as (x - mean) / scale."""
    n = sums[0, 0]
    mean, y_mean = sums[0, 1:-1] / n, sums[0, -1] / n
    spread = sums[1:-1, 1:-1] - n * np.outer(mean, mean)
    cross = sums[1:-1, -1] - n * mean * y_mean
    variance = np.diag(spread) / n
    scale = np.ones_like(mean)
    if model.scaled:
        # A column that is constant up to rounding keeps scale 1.
        usable = variance > 1e-14 * (mean**2 + 1e-300)
        scale[usable] = np.sqrt(variance[usable])
    a, b = spread / np.outer(scale, scale), cross / scale
    if model.penalty == "none":
        unit = np.sqrt(np.clip(np.diag(a), 0, None))
        unit[unit == 0] = 1.0
        w = np.linalg.lstsq(a / np.outer(unit, unit), b / unit, rcond=1e-12)[0] / unit
    elif model.penalty == "l2":
        w = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    else:
        w = _coordinate_descent(a / n, b / n, alpha * l1_ratio, alpha * (1 - l1_ratio))
    if model.scaled:
        return y_mean, w, mean, scale
    return y_mean - float(w @ mean), w, np.zeros_like(mean), scale


def _coordinate_descent(a: np.ndarray, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimise w'aw/2 - b'w + l1 |w| + l2 |w|^2 / 2."""
    w = np.zeros_like(b)
    slack = 1e-9 * max(1.0, np.abs(b).max(initial=0.0))
    for sweep in range(1, MAX_SWEEPS + 1):
        moved = 0.0
        for k in range(len(b)):
            if a[k, k] <= 0:
                continue
            rest = b[k] - a[k] @ w + a[k, k] * w[k]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[k, k] + l2)
            moved = max(moved, abs(new - w[k]))
            w[k] = new
        if moved <= 1e-12 * max(1.0, np.abs(w).max(initial=0.0)):
            break
        if sweep % 10 == 0:
            # Once the set of non-zero weights has settled, the optimum is a linear system.
            on = np.flatnonzero(w)
            exact = np.zeros_like(b)
            exact[on] = np.linalg.lstsq(
                a[np.ix_(on, on)] + l2 * np.eye(len(on)), b[on] - l1 * np.sign(w[on]), rcond=None
            )[0]
            slope = b - a @ exact - l2 * exact
            if np.array_equal(np.sign(exact), np.sign(w)) and np.all(
                np.abs(slope - l1 * np.sign(exact)) <= np.where(exact == 0, l1, 0.0) + slack
            ):
                return exact
    else:
        raise ArithmeticError(f"coordinate descent did not settle within {MAX_SWEEPS} sweeps")
    return w


_FIT_FIELDS = [
    T.StructField("model_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("degree", T.IntegerType()),
    T.StructField("candidate", T.IntegerType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("l1_ratio", T.DoubleType()),
    T.StructField("fit", T.StringType()),  # cv, train or all
    T.StructField("part", T.IntegerType()),
    T.StructField("n_fit", T.LongType()),
    T.StructField("raw_intercept", T.DoubleType()),
    T.StructField("raw_coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("scales", T.ArrayType(T.DoubleType())),
]


def fit_models(
    sums: DataFrame, models: Sequence[LinearModel], scheme: str = "kfold", group: Sequence[str] = GROUP
) -> DataFrame:
    """All grid points of all models, for every fold, for the train rows and for all rows.

    The function below sees a few hundred sums per (group, degree), however many rows the group has.
    """
    group = list(group)
    schema = T.StructType([sums.schema[g] for g in group] + _FIT_FIELDS)
    by_degree: dict[int, list[LinearModel]] = {}
    for m in models:
        by_degree.setdefault(m.degree, []).append(m)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["j"].max()) + 1
        parts: dict[int, np.ndarray] = {}
        for part, block in pdf.groupby("part"):
            matrix = np.zeros((width, width))
            matrix[block["i"], block["j"]] = block["s"]
            parts[int(part)] = matrix + np.triu(matrix, 1).T
        folds = sorted(p for p in parts if p >= 0)
        wanted = []
        for f in folds:
            train = [p for p in folds if (p < f if scheme == "timeseries" else p != f)]
            if train:
                wanted.append(("cv", f, train))
        if folds:
            wanted.append(("train", None, folds))
        wanted.append(("all", None, sorted(parts)))
        out = []
        for label, part, train in wanted:
            total = sum(parts[p] for p in train)
            for model in by_degree[int(pdf["degree"].iloc[0])]:
                for k, (alpha, ratio) in enumerate(model.grid()):
                    b0, w, mean, scale = solve_sums(total, model, alpha, ratio)
                    out.append(
                        [*pdf[group].iloc[0], model.name, model.position, model.degree, k, alpha, ratio,
                         label, part, int(round(total[0, 0])), float(b0), list(w), list(mean), list(scale)]
                    )
        frame = pd.DataFrame(out, columns=schema.names)
        frame["part"] = frame["part"].astype("Int32")
        return frame

    # A set number of tasks: the sums are small, so merging partitions by size would fit all groups in one task.
    spread = sums.repartition(sums.sparkSession.sparkContext.defaultParallelism, *group, "degree")
    return fold_scaler(spread.groupBy(*group, "degree").applyInPandas(fit, schema))


def fold_scaler(fits: DataFrame) -> DataFrame:
    """Express scaled fits over the unscaled features: c/s, and b minus the sum of c*m/s."""
    slope = F.zip_with("raw_coefficients", "scales", lambda c, s: c / s)
    shift = F.aggregate(
        F.zip_with("coefficients", "means", lambda c, m: c * m), F.lit(0.0), lambda a, v: a + v
    )
    return (
        fits.withColumn("coefficients", slope)
        .withColumn("intercept", F.col("raw_intercept") - shift)
        .drop("raw_intercept", "raw_coefficients", "means", "scales")
    )


def predicted() -> Column:
    products = F.zip_with("x", "coefficients", lambda v, c: v * c)
    return F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda a, v: a + v)


def score_aggregates() -> list[Column]:
    """R2 (NULL for fewer than two rows or a constant target), RMSE and MAE of `y_true` and `y_pred`."""
    error = F.col("y_true") - F.col("y_pred")
    total = F.var_pop("y_true") * F.count(F.lit(1))
    return [
        F.when((F.count(F.lit(1)) >= 2) & (F.var_pop("y_true") > 0), 1.0 - F.sum(error * error) / total).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    ]


def fold_scores(designs: DataFrame, fits: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Scores of every grid point on every fold it was not trained on."""
    cv = fits.where(F.col("fit") == "cv").select(
        *group, "degree", "part", "model_name", "position", "candidate", "alpha", "l1_ratio", "intercept", "coefficients"
    )
    tested = lookup_join(
        designs.where(F.col("part") >= 0), cv, [*group, "degree", "part"], [*group, "date"]
    ).withColumn("y_pred", predicted())
    return tested.groupBy(*group, "model_name", "position", "candidate", "alpha", "l1_ratio", "part").agg(
        *score_aggregates()
    )


def pick_candidates(scores: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Best grid point per model by mean fold R2, the first on a tie, with its cross-validation summary.

    The folds that choose a grid point also score it, so the summary is optimistic for tuned models.
    """
    per_candidate = scores.groupBy(*group, "model_name", "position", "candidate", "alpha", "l1_ratio").agg(
        F.when(F.count("r2") == F.count(F.lit(1)), F.avg("r2")).alias("grid_r2"),
        *[
            f(m).alias(f"cv_{m}_{label}")
            for m in ("r2", "rmse", "mae")
            for label, f in (("mean", F.avg), ("std", F.stddev_pop))
        ],
    )
    summary = [f"cv_{m}_{s}" for m in ("r2", "rmse", "mae") for s in ("mean", "std")]
    first = F.min(
        F.struct(F.col("grid_r2").isNull().alias("no"), (-F.col("grid_r2")).alias("neg"), "candidate", "alpha", "l1_ratio", *summary)
    ).alias("b")
    best = per_candidate.groupBy(*group, "model_name", "position").agg(first)
    return best.select(
        *group, "model_name", "position", *[F.col(f"b.{c}").alias(c) for c in ("candidate", "alpha", "l1_ratio", *summary)]
    )


def chosen_predictions(
    designs: DataFrame, fits: DataFrame, picked: DataFrame, group: Sequence[str] = GROUP
) -> DataFrame:
    """Train and test predictions of each model's chosen grid point, fitted on the train rows."""
    train_fits = fits.where(F.col("fit") == "train").join(
        picked.select(*group, "model_name", "candidate"), [*group, "model_name", "candidate"]
    )
    train_fits = train_fits.select(*group, "degree", "model_name", "position", "intercept", "coefficients")
    rows = designs.where(F.col("part") >= HELD_OUT)
    joined = lookup_join(rows, train_fits, [*group, "degree"], [*group, "date"])
    y_pred = joined.withColumn("y_pred", predicted())
    # The two sets are labelled by the part they came from.
    return y_pred.select(
        *group, "date", "model_name", "position", "y_true", "y_pred",
        F.when(F.col("part") == HELD_OUT, "test").otherwise("train").alias("set"),
        (F.col("y_true") - F.col("y_pred")).alias("residual"),
    )


def set_scores(predictions: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Train and test scores side by side, one row per model."""
    per_set = predictions.groupBy(*group, "model_name", "set").agg(*score_aggregates())
    pick = lambda s, m: F.max(F.when(F.col("set") == s, F.col(m))).alias(f"{s}_{m}")
    return per_set.groupBy(*group, "model_name").agg(
        *[pick(s, m) for s in ("train", "test") for m in ("r2", "rmse", "mae")]
    )


def best_model(metrics: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Highest mean fold R2; the first of the catalogue on a tie; models without a score never win."""
    rest = [c for c in metrics.columns if c not in group]
    ranked = F.min(F.struct((-F.col("cv_r2_mean")).alias("neg"), "position", F.struct(*rest).alias("row")))
    best = metrics.where(F.col("cv_r2_mean").isNotNull()).groupBy(*group).agg(ranked.alias("b"))
    return best.select(*group, "b.row.*")


def sorted_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last("cv_r2_mean"), F.desc_nulls_last("test_r2"))
