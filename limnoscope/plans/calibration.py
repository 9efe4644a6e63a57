"""From field samples and pixels to calibrated bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from limnoscope.calibration import config as cfg, linear, splits
from limnoscope.operators import matching
from limnoscope.session import cut_lineage
from limnoscope.sources.files import write_csv, write_json


def calibration_input(
    insitu: DataFrame,
    pixels: DataFrame,
    predictors: Sequence[str],
    window_days: int = 3,
    max_cloud: float = 60,
    min_coverage: float = 50,
    overpass_hours: float = 1.5,
    min_rows: int = 6,
) -> DataFrame:
    """Matched rows: one per (reservoir, variable, date)."""
    dates = cut_lineage(matching.insitu_dates(insitu))
    near = matching.pixels_around(pixels, dates, window_days, max_cloud)
    scenes = matching.scene_features(near, predictors)
    satellite = cut_lineage(
        matching.match_scenes(dates, scenes, window_days, max_cloud, min_coverage, predictors)
    )
    daily = matching.match_overpass(insitu, satellite, overpass_hours)
    return matching.calibration_rows(daily, satellite, predictors, min_rows)


# Train rows that a group needs once its outliers are gone.
MIN_TRAIN = 5


def _of_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among the groups; a NULL key is a key like any other."""
    names = {k: f"_g_{k}" for k in keys}
    same = F.lit(True)
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    return rows.join(groups.select(*keys).withColumnsRenamed(names), same, "left_semi")


@dataclass
class Calibration:
    rows: DataFrame  # rows with split and part
    designs: DataFrame
    fits: DataFrame
    scores: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    best: DataFrame


def calibrate(
    rows: DataFrame,
    predictors: Sequence[str],
    models: Sequence[str] = linear.MODEL_NAMES,
    scheme: str = "kfold",
    folds: int = 5,
    group: Sequence[str] = splits.GROUP,
    key: Sequence[str] = (*splits.GROUP, "date"),
    remove_outliers: bool = True,
    min_train: int = MIN_TRAIN,
) -> Calibration:
    """Fit and score every model for every group at once.

    Groups with fewer than `min_train` train rows after the outliers are left out, and so are, per group, the models
    that need more matched rows than it has.

    The matched rows and the fits are small against the pixels and are read by several jobs, so they
    are checkpointed.
    """
    chosen = linear.chosen_models(models)
    usable = rows.where(F.col("gate") == "ok") if "gate" in rows.columns else rows
    parts = cut_lineage(splits.assign_parts(cut_lineage(usable), scheme, folds, group, key, remove_outliers))
    keep = list(dict.fromkeys([*group, *key, "y_true", "part"]))
    enough = parts.groupBy(*group).agg(F.count_if(F.col("split") == "train").alias("_train")).where(F.col("_train") >= min_train)
    parts = cut_lineage(_of_groups(parts, enough, group))
    designs = linear.with_designs(parts, predictors, [m.degree for m in chosen], keep)
    offered = cfg.offered_models(parts, [m.name for m in chosen], group)
    fits = linear.fit_models(linear.product_sums(designs, group), chosen, scheme, group)
    fits = cut_lineage(_of_groups(fits, offered, [*group, "model_name"]))
    scores = linear.fold_scores(designs, fits, group)
    picked = cut_lineage(linear.pick_candidates(scores, group))
    predictions = linear.chosen_predictions(designs, fits, picked, group)
    sizes = parts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_samples_after_merge"),
        F.count_if(F.col("split") != "test").alias("train_samples_before_outliers"),
        F.count_if(F.col("split") == "train").alias("train_samples_after_outliers"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
        F.count_if(F.col("split") == "outlier").alias("n_outliers_removed_train"),
    )
    params = F.to_json(F.struct("alpha", "l1_ratio"))
    metrics = (
        picked.join(linear.set_scores(predictions, group), [*group, "model_name"])
        .join(sizes, list(group))
        .withColumn("best_params", params)
        .withColumn("predictor_set", F.lit(", ".join(predictors)))
    )
    return Calibration(parts, designs, fits, scores, metrics, predictions, linear.best_model(metrics, group))


def configurations(result: Calibration, predictors: Sequence[str], group: Sequence[str] = splits.GROUP) -> DataFrame:
    """Per-pixel configurations of the best models, refitted on all rows."""
    medians = cfg.predictor_medians(result.rows, predictors, group)
    return cfg.raster_config(result.best, result.fits, medians, predictors, group)


def write_bundle(result: Calibration, predictors: Sequence[str], path: str, tree_models: Mapping | None = None) -> None:
    """Store configuration, metrics, predictions and removed outliers, and any fitted tree models."""
    write_json(configurations(result, predictors), f"{path}/configuration")
    write_csv(linear.sorted_metrics(result.metrics), f"{path}/metrics")
    write_csv(result.predictions.orderBy("set", "date"), f"{path}/predictions")
    removed = result.rows.where(F.col("split") == "outlier").withColumn("reason", F.lit("iqr"))
    write_csv(removed.select(*splits.GROUP, "date", "y_true", "reason"), f"{path}/removed_outliers")
    for name, model in (tree_models or {}).items():
        model.write().overwrite().save(f"{path}/{name}")
