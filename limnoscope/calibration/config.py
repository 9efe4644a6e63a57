"""Calibration configuration: built from the chosen model, stored, and applied per pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.calibration.linear import CATALOGUE
from limnoscope.calibration.splits import GROUP
from limnoscope.calibration.trees import MIN_ROWS
from limnoscope.functions import masks, spectral
from limnoscope.functions.numeric import at_least_zero
from limnoscope.functions.text import calibrated_band_name
from limnoscope.operators.quantiles import grouped_distribution
from limnoscope.operators.sizing import lookup_join

# Sample-size gates of the whole catalogue: (name, position, least rows).
GATES = tuple((m.name, m.position, m.min_rows) for m in CATALOGUE) + (
    ("random_forest", 6, MIN_ROWS), ("gradient_boosting", 7, MIN_ROWS),
)
RASTERIZABLE = tuple(m.name for m in CATALOGUE if m.rasterizable)


def offered_models(rows: DataFrame, requested: Sequence[str], group: Sequence[str] = GROUP) -> DataFrame:
    """Requested models each group has enough matched rows for (all of its rows count, not the train rows)."""
    gates = rows.sparkSession.createDataFrame(
        [g for g in GATES if g[0] in requested], "model_name string, position int, min_rows int"
    )
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"))
    # The gates are a constant of this module.
    return sizes.join(F.broadcast(gates), F.col("n_rows") >= F.col("min_rows")).drop("min_rows")


def predictor_medians(rows: DataFrame, predictors: Sequence[str], group: Sequence[str] = GROUP) -> DataFrame:
    """Exact median of each predictor per group as an array in predictor order; 0 where there is none."""
    long = rows.select(*group, *predictors).unpivot(list(group), list(predictors), "predictor", "v")
    medians = grouped_distribution(long, [*group, "predictor"], "v", {"median": 0.5})
    pick = lambda p: F.coalesce(F.max(F.when(F.col("predictor") == p, F.col("median"))), F.lit(0.0))
    return medians.groupBy(*group).agg(F.array(*[pick(p) for p in predictors]).alias("fill_values"))


def impute_medians(rows: DataFrame, predictors: Sequence[str], group: Sequence[str] = GROUP) -> DataFrame:
    """Fill missing predictors with the exact median of their group."""
    medians = predictor_medians(rows, predictors, group)
    joined = lookup_join(rows, medians, list(group), [*group, "date"])
    filled = {p: F.coalesce(F.col(p), F.col("fill_values")[i]) for i, p in enumerate(predictors)}
    return joined.withColumns(filled).drop("fill_values")


def standardise(rows: DataFrame, predictors: Sequence[str], group: Sequence[str] = GROUP) -> DataFrame:
    """Centre and divide by the population deviation; a constant column is only centred."""
    stats = rows.groupBy(*group).agg(
        *[F.avg(p).alias(f"_m_{p}") for p in predictors], *[F.stddev_pop(p).alias(f"_s_{p}") for p in predictors]
    )
    joined = lookup_join(rows, stats, list(group), [*group, "date"])
    scale = lambda p: F.when(F.col(f"_s_{p}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{p}"))
    return joined.withColumns({p: (F.col(p) - F.col(f"_m_{p}")) / scale(p) for p in predictors}).select(*rows.columns)


def raster_config(
    best: DataFrame, fits: DataFrame, medians: DataFrame, predictors: Sequence[str], group: Sequence[str] = GROUP
) -> DataFrame:
    """One configuration per group; `available` is false for models that are no plain linear band."""
    final = fits.where(F.col("fit") == "all").select(*group, "model_name", "candidate", "intercept", "coefficients")
    joined = best.join(final, [*group, "model_name", "candidate"]).join(medians, list(group))
    linear = F.col("model_name").isin(*RASTERIZABLE)
    when_linear = lambda c: F.when(linear, c)
    return joined.select(
        *group, "model_name", linear.alias("available"),
        F.when(~linear, F.concat(F.lit("model "), F.col("model_name"), F.lit(" is no linear band"))).alias("reason"),
        calibrated_band_name(F.col("variable")).alias("band_name"),
        F.array(*[F.lit(p) for p in predictors]).alias("predictor_set"),
        when_linear(F.col("intercept")).alias("intercept"),
        when_linear(F.col("coefficients")).alias("coefficients"),
        when_linear(F.col("fill_values")).alias("fill_values"),
    )


def config_json(config: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in config.columns]))


def calibrated_band(
    pixels: DataFrame, config: DataFrame, predictors: Sequence[str], out: str = "calibrated", variable: str | None = None
) -> DataFrame:
    """Apply each reservoir's linear configuration to its pixels, clamped at zero and cloud-masked.

    With `variable`, only its configurations count; several for one reservoir are an error, so pixels never multiply.
    The predictors' order comes from the configuration; one without `predictor_set` follows `predictors`. A masked predictor takes its fill value. Reservoirs without a
    configuration keep NULL.
    """
    return calibrated_bands(pixels, config, predictors, {out: variable})


def calibrated_bands(pixels: DataFrame, config: DataFrame, predictors: Sequence[str], bands: dict[str, str | None]) -> DataFrame:
    """One column per entry of `bands` (column name to variable, None for configurations of any), in one join."""
    spectral.check_bands(pixels, predictors)
    usable = config.where("available")
    if "predictor_set" not in config.columns:
        usable = usable.withColumn("predictor_set", F.array(*[F.lit(p) for p in predictors]))
    # Everything that does not hang on a pixel is worked out on the configurations: plain columns in the caller's order.
    terms = ["intercept", *[f"{kind}{i}" for i in range(len(predictors)) for kind in ("c", "f")]]
    plain = {"c_intercept": F.col("intercept")}
    for i, name in enumerate(predictors):
        at = F.array_position("predictor_set", name).cast("int")
        # A predictor that the configuration does not name adds nothing.
        plain[f"c_c{i}"] = F.when(at > 0, F.get("coefficients", at - 1)).otherwise(F.lit(0.0))
        plain[f"c_f{i}"] = F.when(at > 0, F.get("fill_values", at - 1)).otherwise(F.lit(0.0))
    usable = usable.withColumns(plain)
    picked = []
    for k, variable in enumerate(bands.values()):
        mine = F.lit(True) if variable is None else F.col("variable") == variable
        picked.append(F.count(F.when(mine, 1)).alias(f"_n{k}"))
        picked += [F.max(F.when(mine, F.col(f"c_{t}"))).alias(f"_{t}_{k}") for t in terms]
    single = usable.groupBy("reservoir_id").agg(*picked)
    for k in range(len(bands)):
        several = F.raise_error(F.concat(F.lit("several configurations for reservoir "), F.col("reservoir_id").cast("string"))).cast("double")
        single = single.withColumn(f"_intercept_{k}", F.when(F.col(f"_n{k}") > 1, several).otherwise(F.col(f"_intercept_{k}")))
    own = [f"_{t}_{k}" for k in range(len(bands)) for t in terms]
    joined = lookup_join(pixels, single.select("reservoir_id", *own), ["reservoir_id"], ["pixel_id"], how="left")
    totals = {}
    for k in range(len(bands)):
        total = F.col(f"_intercept_{k}")
        for i, name in enumerate(predictors):
            total = total + F.coalesce(spectral.index_column(name), F.col(f"_f{i}_{k}")) * F.col(f"_c{i}_{k}")
        totals[f"_total_{k}"] = total
    # The sum is a column of its own, since clamping reads it twice.
    summed = joined.withColumns(totals)
    clear = masks.clear_for_indices(F.col("scl"))
    shown = {out: masks.masked(at_least_zero(F.col(f"_total_{k}")), clear) for k, out in enumerate(bands)}
    return summed.withColumns(shown).drop(*own, *totals)
