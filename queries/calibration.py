"""Calibration: matched rows, splits, fits, scores, per-pixel bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnoscope.calibration import config as cfg, forests, linear, splits, trees
from limnoscope.operators import quantiles, reduction
from limnoscope.plans import calibration as plan
from limnoscope.session import cut_lineage
from queries import standins as s
from queries.matching import PREDICTORS, prepared
from queries.products import SQL_CLEAR, SQL_PREDICTOR, SQL_WATER
from queries.registry import fixed, query, sql_fixed

SQL_NAMES = dict(zip(PREDICTORS, ("ndci", "r740", "tb783")))
SINGLE = ("NDCI_705_665",)


def _line(prefix: str = "") -> str:
    """Least squares in SQL; with one value of the predictor it is the flat line through the mean."""
    y, x = f"{prefix}y_true", f"{prefix}ndci"
    return (
        f"case when var_pop({x}) > 0 then regr_slope({y}, {x}) else 0e0 end b,"
        f" case when var_pop({x}) > 0 then regr_intercept({y}, {x}) else avg({y}) end a"
    )


_LINE, _T_LINE = _line(), _line("t.")


def rows(spark, sf, predictors=PREDICTORS):
    return plan.calibration_input(prepared(spark, sf), s.pixel(spark, sf), predictors)


def gated(spark, sf):
    found = rows(spark, sf)
    return found.where(F.col("gate") == "ok").select("reservoir_id", "variable", "date", "y_true", *PREDICTORS)


def marked(spark, sf):
    """Rows after split and outlier removal; written once, as several ranks read them."""
    split = splits.holdout_split(cut_lineage(gated(spark, sf)))
    return cut_lineage(splits.mark_outliers(split))


@query(
    s.with_views("calib")
    + f"""select reservoir_id, variable, d as "date", n_rows, case when n_rows < 6 then 'too few matched rows' else 'ok' end gate,
    {sql_fixed('y_true')} y_true, """
    + ", ".join(f'{sql_fixed(v)} "{k}"' for k, v in SQL_NAMES.items()) + " from calib"
)
def calibration_input(spark, sf):
    """Field means joined to scene predictors, with the sample-size gate."""
    return rows(spark, sf).select(
        "reservoir_id", "variable", "date", "n_rows", "gate", *[fixed(c).alias(c) for c in ("y_true", *PREDICTORS)]
    )


@query(s.with_views("held") + 'select reservoir_id, variable, d as "date", split from held')
def holdout_split(spark, sf):
    """Test and train rows in hash order."""
    split = splits.holdout_split(cut_lineage(gated(spark, sf)))
    return split.select("reservoir_id", "variable", "date", "split")


@query(s.with_views("cleaned") + f'select reservoir_id, variable, d as "date", {sql_fixed("y_true")} y_true, split from cleaned')
def train_outliers(spark, sf):
    """Train rows beyond the quartile fence of their group are taken out."""
    return marked(spark, sf).select("reservoir_id", "variable", "date", fixed("y_true").alias("y_true"), "split")


@query(s.with_views("folded") + 'select reservoir_id, variable, d as "date", fold from folded')
def kfold_assign(spark, sf):
    """Shuffled folds of the train rows."""
    folded = splits.kfold(marked(spark, sf).where(F.col("split") == "train"))
    return folded.select("reservoir_id", "variable", "date", "fold")


@query(s.with_views("folded") + 'select reservoir_id, variable, d as "date", block from folded')
def timeseries_folds(spark, sf):
    """Blocks by time; each is tested after training on the earlier ones."""
    blocks = splits.time_blocks(marked(spark, sf).where(F.col("split") == "train"))
    return blocks.select("reservoir_id", "variable", "date", "block")


@query(
    s.with_views(
        "samples",
        q="""select reservoir_id, variable, count(*) n_obs, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3
          from samples group by 1,2""",
    )
    + f"""select q.reservoir_id, q.variable, n_obs, {sql_fixed('min(q1)')} q1, {sql_fixed('min(q3)')} q3,
      {sql_fixed('min(q1 - 1.5e0*(q3-q1))')} low, {sql_fixed('min(q3 + 1.5e0*(q3-q1))')} high,
      count_if(s.value < q1 - 1.5e0*(q3-q1) or s.value > q3 + 1.5e0*(q3-q1))::bigint n_outside
    from q join samples s on s.reservoir_id = q.reservoir_id and s.variable = q.variable group by 1,2,3"""
)
def iqr_outliers(spark, sf):
    """Exact quartiles, fences and rows outside them, over all samples of each reservoir and variable."""
    from limnoscope.operators.sizing import lookup_join

    samples = s.samples(spark, sf)
    keys = ["reservoir_id", "variable"]
    fence = quantiles.iqr_fence(samples, keys, "value")
    judged = lookup_join(samples, fence, keys, ["event_id"])
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return judged.groupBy(*keys, "n_obs").agg(
        *[fixed(F.min(c)).alias(c) for c in ("q1", "q3", "low", "high")], F.count_if(outside).alias("n_outside")
    )


@query(
    s.with_views("gated")
    + f"""select reservoir_id, variable, count(*) n_fit, {sql_fixed('regr_slope(y_true, ndci)')} slope,
      {sql_fixed('regr_intercept(y_true, ndci)')} intercept from gated group by 1,2"""
)
def linear_fit_single(spark, sf):
    """Least squares with one predictor on all rows."""
    data = gated(spark, sf).withColumn("part", F.lit(0))
    designs = linear.with_designs(data, SINGLE, [1], ["reservoir_id", "variable", "date", "y_true", "part"])
    fits = linear.fit_models(linear.product_sums(designs), linear.chosen_models(["linear"]))
    return fits.where(F.col("fit") == "all").select(
        "reservoir_id", "variable", "n_fit", fixed(F.col("coefficients")[0]).alias("slope"), fixed("intercept").alias("intercept")
    )


_POINTS = ",".join(
    [f"('ridge', {k}, {a}e0, 0e0)" for k, a in enumerate((0.01, 0.1, 1.0, 10.0, 100.0))]
    + [f"('lasso', {k}, {a}e0, 1e0)" for k, a in enumerate((0.001, 0.01, 0.1, 1.0))]
    + [f"('elastic_net', {3 * i + j}, {a}e0, {r}e0)" for i, a in enumerate((0.001, 0.01, 0.1, 1.0)) for j, r in enumerate((0.2, 0.5, 0.8))]
)


@query(
    s.with_views(
        "gated",
        m="""select reservoir_id, variable, count(*) n, avg(ndci) mx, avg(y_true) my, stddev_pop(ndci) sx,
          covar_pop(y_true, ndci)/stddev_pop(ndci) c from gated group by 1,2""",
        p=f"select * from (values {_POINTS}) p(model_name, candidate, alpha, l1_ratio)",
        w="""select m.*, p.*, case when model_name = 'ridge' then n*c/(n+alpha)
          else sign(c)*greatest(abs(c) - alpha*l1_ratio, 0e0)/(1e0+alpha*(1e0-l1_ratio)) end w from m join p on true""",
    )
    + f"""select reservoir_id, variable, model_name, candidate, {sql_fixed('w/sx')} slope, {sql_fixed('my - w*mx/sx')} intercept from w"""
)
def penalised_fit_single(spark, sf):
    """Ridge, lasso and elastic net over their whole grids with one predictor, against the closed forms."""
    data = gated(spark, sf).withColumn("part", F.lit(0))
    designs = linear.with_designs(data, SINGLE, [1], ["reservoir_id", "variable", "date", "y_true", "part"])
    models = linear.chosen_models(["ridge", "lasso", "elastic_net"])
    fits = linear.fit_models(linear.product_sums(designs), models)
    return fits.where(F.col("fit") == "all").select(
        "reservoir_id", "variable", "model_name", "candidate",
        fixed(F.col("coefficients")[0]).alias("slope"), fixed("intercept").alias("intercept"),
    )


_SINGLE_FIT = s.with_views(
    "folded_modelled", "modelled",
    train_fit=f"select reservoir_id, variable, {_LINE} from folded_modelled group by 1,2",
    pred="""select c.reservoir_id, c.variable, c.d, c.split, c.y_true, f.a + f.b*c.ndci y_pred from modelled c
      join train_fit f using (reservoir_id, variable) where c.split <> 'outlier'""",
    fold_fit=f"""select t.reservoir_id, t.variable, f.fold, {_T_LINE}
      from folded_modelled t join (select distinct reservoir_id, variable, fold from folded_modelled) f
      on f.reservoir_id = t.reservoir_id and f.variable = t.variable and t.fold <> f.fold group by 1,2,3""",
    fold_score="""select f.reservoir_id, f.variable, f.fold,
      case when count(*) >= 2 and var_pop(y_true) > 0 then 1e0 - sum((y_true - (a + b*ndci))**2)/(var_pop(y_true)*count(*)) end r2,
      sqrt(avg((y_true - (a + b*ndci))**2)) rmse, avg(abs(y_true - (a + b*ndci))) mae
      from folded_modelled f join fold_fit using (reservoir_id, variable, fold) group by 1,2,3""",
    cv="""select reservoir_id, variable, avg(r2) r2m, stddev_pop(r2) r2s, avg(rmse) rmsem, stddev_pop(rmse) rmses,
      avg(mae) maem, stddev_pop(mae) maes from fold_score group by 1,2""",
    sets="""select reservoir_id, variable, split,
      case when count(*) >= 2 and var_pop(y_true) > 0 then 1e0 - sum((y_true - y_pred)**2)/(var_pop(y_true)*count(*)) end r2,
      sqrt(avg((y_true - y_pred)**2)) rmse, avg(abs(y_true - y_pred)) mae, count(*) n from pred group by 1,2,3""",
)


@query(
    _SINGLE_FIT + f"""select reservoir_id, variable, d as "date", split as "set", {sql_fixed('y_true')} y_true, {sql_fixed('y_pred')} y_pred,
    {sql_fixed('y_true - y_pred')} residual from pred"""
)
def model_predictions(spark, sf):
    """Train and test predictions of the one-predictor line."""
    result = plan.calibrate(gated(spark, sf), SINGLE, ["linear"])
    return result.predictions.select(
        "reservoir_id", "variable", "date", "set", *[fixed(c).alias(c) for c in ("y_true", "y_pred", "residual")]
    )


_METRICS = {
    "cv_r2_mean": "cv.r2m", "cv_r2_std": "cv.r2s", "cv_rmse_mean": "cv.rmsem", "cv_rmse_std": "cv.rmses",
    "cv_mae_mean": "cv.maem", "cv_mae_std": "cv.maes", "train_r2": "a.r2", "train_rmse": "a.rmse", "train_mae": "a.mae",
    "test_r2": "b.r2", "test_rmse": "b.rmse", "test_mae": "b.mae",
}


@query(
    _SINGLE_FIT + "select reservoir_id, variable, 'linear' model_name, a.n train_samples_after_outliers, b.n test_samples, "
    + ", ".join(f"{sql_fixed(e)} {c}" for c, e in _METRICS.items())
    + """ from cv join (select * from sets where split = 'train') a using (reservoir_id, variable)
    join (select * from sets where split = 'test') b using (reservoir_id, variable)"""
)
def model_metrics_linear(spark, sf):
    """Cross-validation, train and test scores of the one-predictor line."""
    result = plan.calibrate(gated(spark, sf), SINGLE, ["linear"])
    return linear.sorted_metrics(result.metrics).select(
        "reservoir_id", "variable", "model_name", "train_samples_after_outliers", "test_samples",
        *[fixed(c).alias(c) for c in _METRICS],
    )


_TIME_FIT = s.with_views(
    "folded_modelled",
    block_fit=f"""select t.reservoir_id, t.variable, f.block, {_T_LINE}
      from folded_modelled t join (select distinct reservoir_id, variable, block from folded_modelled where block > 0) f
      on f.reservoir_id = t.reservoir_id and f.variable = t.variable and t.block < f.block group by 1,2,3""",
    block_score="""select reservoir_id, variable, block, count(*) n, sqrt(avg((y_true - (a + b*ndci))**2)) rmse,
      avg(abs(y_true - (a + b*ndci))) mae from folded_modelled join block_fit using (reservoir_id, variable, block) group by 1,2,3""",
)


@query(_TIME_FIT + f"select reservoir_id, variable, block as part, n, {sql_fixed('rmse')} rmse, {sql_fixed('mae')} mae from block_score")
def timeseries_scores(spark, sf):
    """Scores per time block of the line trained on the earlier blocks."""
    result = plan.calibrate(gated(spark, sf), SINGLE, ["linear"], scheme="timeseries")
    return result.scores.select("reservoir_id", "variable", "part", "n", fixed("rmse").alias("rmse"), fixed("mae").alias("mae"))


@query(
    s.with_views("calib")
    + """select reservoir_id, variable, g.model_name, count(*) n_rows from calib,
    (values ('linear',0),('ridge',0),('poly3',0),('random_forest',18),('gradient_boosting',18)) g(model_name, least)
    group by 1,2,3,g.least having count(*) >= g.least"""
)
def model_catalogue(spark, sf):
    """Models offered to each reservoir and variable by their number of matched rows."""
    offered = cfg.offered_models(rows(spark, sf), ["linear", "ridge", "poly3", "random_forest", "gradient_boosting"])
    return offered.select("reservoir_id", "variable", "model_name", "n_rows")


# Three standardised predictors: ridge by determinants, lasso and elastic net by sweeps over the three weights.
_GRID = ",".join(
    f"('{m.name}', {m.position}, {k}, {a}e0, {r}e0)" for m in linear.chosen_models(["ridge", "lasso", "elastic_net"]) for k, (a, r) in enumerate(m.grid())
)
_SOFT = "(sign({0})*greatest(abs({0}) - l1, 0e0)/(1e0 + l2))"
# Weights that no longer move take part in no further sweep.
_SWEEPS = 40_000
_W1 = _SOFT.format("(b1 - c12*w2 - c13*w3)")
_W2 = _SOFT.format("(b2 - c12*v1 - c23*w3)")
_W3 = _SOFT.format("(b3 - c13*v1 - c23*v2)")
_GRID_FIT = s.with_views(
    "folded",
    enough="select * from folded where n_train >= 10",
    train="""select f.reservoir_id, f.variable, f.fold as part, count(*) n, avg(y_true) my, avg(ndci) m1, avg(r740) m2, avg(tb783) m3,
        stddev_pop(ndci) s1, stddev_pop(r740) s2, stddev_pop(tb783) s3,
        covar_pop(ndci, r740)/(stddev_pop(ndci)*stddev_pop(r740)) c12, covar_pop(ndci, tb783)/(stddev_pop(ndci)*stddev_pop(tb783)) c13,
        covar_pop(r740, tb783)/(stddev_pop(r740)*stddev_pop(tb783)) c23, covar_pop(y_true, ndci)/stddev_pop(ndci) b1,
        covar_pop(y_true, r740)/stddev_pop(r740) b2, covar_pop(y_true, tb783)/stddev_pop(tb783) b3
      from enough t join (select distinct reservoir_id, variable, fold from enough) f
      on f.reservoir_id = t.reservoir_id and f.variable = t.variable and t.fold <> f.fold group by 1,2,3""",
    point=f"select * from (values {_GRID}) p(model_name, position, candidate, alpha, l1_ratio)",
    setting="select *, row_number() over () k, alpha*l1_ratio l1, alpha*(1e0 - l1_ratio) l2, 1e0 + alpha/n d from train join point on true",
    swept=f"""select k, 0 sweep, 0e0 w1, 0e0 w2, 0e0 w3, 1e0 moved from setting where model_name <> 'ridge' union all
      select k, sweep + 1, v1, v2, v3, greatest(abs(v1 - w1), abs(v2 - w2), abs(v3 - w3)) from (select *, {_W3} v3 from (select *, {_W2} v2 from
        (select a.*, z.sweep, z.w1, z.w2, z.w3, {_W1} v1 from swept z join setting a using (k) where z.sweep < {_SWEEPS} and z.moved > 1e-13)))""",
    ridge="select *, d*(d*d - c23*c23) - c12*(c12*d - c23*c13) + c13*(c12*c23 - d*c13) det from setting where model_name = 'ridge'",
    weight="""select k, arg_max(w1, sweep) w1, arg_max(w2, sweep) w2, arg_max(w3, sweep) w3 from swept group by k union all
      select k, (b1*(d*d - c23*c23) - c12*(b2*d - c23*b3) + c13*(b2*c23 - d*b3))/det,
        (d*(b2*d - c23*b3) - b1*(c12*d - c23*c13) + c13*(c12*b3 - b2*c13))/det,
        (d*(d*b3 - b2*c23) - c12*(c12*b3 - b2*c13) + b1*(c12*c23 - d*c13))/det from ridge""",
    guess="""select a.reservoir_id, a.variable, a.model_name, a.position, a.candidate, a.alpha, a.l1_ratio, a.part, f.y_true,
        my + w1*(ndci - m1)/s1 + w2*(r740 - m2)/s2 + w3*(tb783 - m3)/s3 y_pred
      from setting a join weight using (k) join enough f on f.reservoir_id = a.reservoir_id and f.variable = a.variable and f.fold = a.part""",
).replace("with ", "with recursive ", 1)


@query(
    _GRID_FIT
    + f"""select reservoir_id, variable, model_name, position, candidate, alpha, l1_ratio, part, count(*) n,
      {sql_fixed('case when count(*) >= 2 and var_pop(y_true) > 0 then 1e0 - sum((y_true - y_pred)**2)/(var_pop(y_true)*count(*)) end', 4)} r2,
      {sql_fixed('sqrt(avg((y_true - y_pred)**2))', 5)} rmse, {sql_fixed('avg(abs(y_true - y_pred))', 5)} mae
    from guess group by 1,2,3,4,5,6,7,8"""
)
def ridge_lasso_enet_grid(spark, sf):
    """Fold scores of every grid point of the penalised models over three predictors, for groups of ten train rows.

    With fewer rows the three weights are hardly determined, and any two solvers part in the third digit.
    """
    scores = plan.calibrate(gated(spark, sf), PREDICTORS, ["ridge", "lasso", "elastic_net"], min_train=10).scores
    return scores.select(
        "reservoir_id", "variable", "model_name", "position", "candidate", "alpha", "l1_ratio", "part", "n",
        fixed("r2", 4).alias("r2"), fixed("rmse", 5).alias("rmse"), fixed("mae", 5).alias("mae"),
    )


@query()
def poly_models(spark, sf):
    """Scores of the polynomial models."""
    return plan.calibrate(gated(spark, sf), PREDICTORS, ["poly2", "poly3"]).metrics


@query()
def best_model(spark, sf):
    """Best model of every reservoir and variable over the whole linear catalogue."""
    return plan.calibrate(gated(spark, sf), PREDICTORS).best


@query()
def raster_configurations(spark, sf):
    """Per-pixel configurations of the best models."""
    return plan.configurations(plan.calibrate(gated(spark, sf), PREDICTORS), PREDICTORS)


_TREE_GRIDS = {
    "random_forest": {"numTrees": (100,), "maxDepth": (3,), "minInstancesPerNode": (2,)},
    "gradient_boosting": {"maxIter": (10,), "stepSize": (0.1,), "maxDepth": (2,)},
}


@query()
def tree_models(spark, sf):
    """Forest and boosting over the pooled rows of all reservoirs and variables, one grid point each."""
    pooled = gated(spark, sf).withColumn("pool", F.lit("all"))
    key = ("reservoir_id", "variable", "date")
    parts = cut_lineage(splits.assign_parts(cut_lineage(pooled), "kfold", 3, ("pool",), key))
    metrics, _, _ = trees.fit_tree_models(parts, PREDICTORS, grids=_TREE_GRIDS)
    return metrics


@query()
def forest_models(spark, sf):
    """Forests of every reservoir and variable at once over the whole grid: scores of the chosen grid points."""
    parts = cut_lineage(splits.assign_parts(cut_lineage(gated(spark, sf)), "kfold", 5))
    return forests.fit_forests(parts, PREDICTORS).metrics


# --- calibrated bands ------------------------------------------------------------------------------------
# Coefficients of a given configuration, varied by reservoir through the key.
_TERMS = {"NDCI_705_665": (12.5, 0.1), "R740_R665": (-1.75, 0.9), "TB_783": (40.0, 0.0)}


def _given_config(spark, sf):
    """One configuration per region."""
    regions = s.table(spark, sf, "region")
    key = F.col("r_regionkey")
    return regions.select(
        key.alias("reservoir_id"), F.lit(True).alias("available"), (key * 0.5 + 1.25).cast("double").alias("intercept"),
        F.array(*[F.lit(c) * (key + 1) for c, _ in _TERMS.values()]).alias("coefficients"),
        F.array(*[F.lit(f) for _, f in _TERMS.values()]).alias("fill_values"),
        F.array(*[F.lit(n) for n in _TERMS]).alias("predictor_set"),
    )


_BAND = "reservoir_id*0.5e0 + 1.25e0 + " + " + ".join(
    f"coalesce({SQL_PREDICTOR[n]}, {f}e0) * ({c}e0*(reservoir_id+1))" for n, (c, f) in _TERMS.items()
)


@query(
    s.with_views("pixel", v=f"select pixel_id, reservoir_id, scl, {_BAND} as band from pixel")
    + f"select pixel_id, reservoir_id, {sql_fixed(f'case when {SQL_CLEAR} then case when band < 0 then 0e0 else band end end')} calibrated from v"
)
def calibrated_band(spark, sf):
    """A given configuration per reservoir applied to every pixel."""
    band = cfg.calibrated_band(s.pixel(spark, sf), _given_config(spark, sf), list(_TERMS))
    return band.select("pixel_id", "reservoir_id", fixed("calibrated").alias("calibrated"))


@query(
    s.with_views("pixel", v=f"select pixel_id, reservoir_id, scl, {_BAND} as band from pixel")
    + "select pixel_id, reservoir_id, " + ", ".join(
        sql_fixed(f"case when {SQL_CLEAR} then case when {b} < 0 then 0e0 else {b} end end") + f" {n}"
        for n, b in (("phycocyanin", "band"), ("chlorophyll", "(band + 3e0)"))
    ) + ", null::double turbidity from v"
)
def calibrated_bands_all(spark, sf):
    """Bands of several variables at once; every pixel stays one row, a variable without configurations is NULL."""
    given = _given_config(spark, sf)
    both = given.withColumn("variable", F.lit("phycocyanin")).unionByName(
        given.withColumn("variable", F.lit("chlorophyll")).withColumn("intercept", F.col("intercept") + 3)
    )
    # Configurations name their predictors, so the caller's order does not matter.
    bands = cfg.calibrated_bands(s.pixel(spark, sf), both, list(_TERMS)[::-1], {v: v for v in ("phycocyanin", "chlorophyll", "turbidity")})
    return bands.select("pixel_id", "reservoir_id", *[fixed(v).alias(v) for v in ("phycocyanin", "chlorophyll", "turbidity")])


@query(
    s.with_views(
        "best", "pixel",
        v=f"select *, case when {SQL_CLEAR} then case when band < 0 then 0e0 else band end end shown from (select *, {_BAND} as band from pixel)",
        means=f"""select reservoir_id, scene_date, tile, avg(case when {SQL_WATER} then shown end) calibrated
          from best join v using (reservoir_id, scene_date, tile) group by 1,2,3""",
    )
    + f"select reservoir_id, scene_date, tile, {sql_fixed('calibrated')} calibrated from means where calibrated is not null"
)
def calibrated_daily_mean(spark, sf):
    """The calibrated band averaged over water like any other index."""
    band = cfg.calibrated_band(s.pixel(spark, sf), _given_config(spark, sf), list(_TERMS))
    means = reduction.reservoir_daily_means(band, ["calibrated"], dark_year=s.DARK_YEAR)
    return means.select("reservoir_id", "scene_date", "tile", fixed("calibrated").alias("calibrated"))


@query(
    s.with_views(
        "gated", "pixel",
        model=f"""select reservoir_id, {_LINE}, median(ndci) fill
          from gated where variable = 'phycocyanin' group by 1""",
        v=f"""select p.*, a + b*coalesce({SQL_PREDICTOR['NDCI_705_665']}, fill) as band from pixel p join model using (reservoir_id)""",
    )
    + f"""select reservoir_id, scene_date, tile, {sql_fixed(f'avg(case when {SQL_CLEAR} then case when band < 0 then 0e0 else band end end)')} calibrated_mean
    from v group by 1,2,3"""
)
def calibration_end_to_end(spark, sf):
    """Match, fit, configure, apply per pixel and average per scene."""
    data = cut_lineage(gated(spark, sf).where(F.col("variable") == "phycocyanin")).withColumn("part", F.lit(0))
    designs = linear.with_designs(data, SINGLE, [1], ["reservoir_id", "variable", "date", "y_true", "part"])
    fits = cut_lineage(linear.fit_models(linear.product_sums(designs), linear.chosen_models(["linear"])))
    best = fits.where(F.col("fit") == "all").select("reservoir_id", "variable", "model_name", "candidate")
    config = cut_lineage(cfg.raster_config(best, fits, cfg.predictor_medians(data, SINGLE), SINGLE))
    band = cfg.calibrated_band(s.pixel(spark, sf), config, SINGLE)
    configured = band.join(F.broadcast(config.select("reservoir_id")), "reservoir_id", "left_semi")
    return configured.groupBy("reservoir_id", "scene_date", "tile").agg(
        fixed(F.avg("calibrated")).alias("calibrated_mean")
    )


@query(
    s.with_views("feature", g="select reservoir_id, scene_date, tile, case when day(scene_date) <> 11 then ndci end ndci, case when tile = 0 then r740 end r740 from feature")
    + f"""select reservoir_id, scene_date, tile, {sql_fixed('coalesce(ndci, median(ndci) over (partition by reservoir_id), 0e0)')} ndci,
      {sql_fixed('coalesce(r740, median(r740) over (partition by reservoir_id), 0e0)')} r740 from g"""
)
def median_imputation(spark, sf):
    """Missing scene predictors filled with the exact median of their reservoir."""
    from limnoscope.operators import matching

    scenes = matching.scene_features(s.pixel(spark, sf)).select(
        "reservoir_id", "tile", F.col("scene_date").alias("date"),
        F.when(F.dayofmonth("scene_date") != 11, F.col("NDCI_705_665")).alias("ndci"), F.when(F.col("tile") == 0, F.col("R740_R665")).alias("r740"),
    )
    filled = cfg.impute_medians(cut_lineage(scenes), ["ndci", "r740"], ["reservoir_id"])
    return filled.select("reservoir_id", F.col("date").alias("scene_date"), "tile", fixed("ndci").alias("ndci"), fixed("r740").alias("r740"))
