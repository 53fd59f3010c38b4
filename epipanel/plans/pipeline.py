"""The monthly pipeline from a line list to scores, one stored table per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.operators import calibrate, checks, covariates, ensemble, features, panel, residual_regression, scoring
from epipanel.operators.access import pick
from epipanel.operators.models import run_model
from epipanel.operators.summaries import delta_by_horizon
from epipanel.schema import CASES, DATE, GID_1, GID_2, HORIZON, MODEL, QUANTILE_LEVELS
from epipanel.sources.registry import SourceRegistry
from epipanel.sources.tables import read_table, write_csv, write_table


def build_cases(cases: DataFrame, regions: DataFrame, path: str, freq: str = "M", future: int = 12,
                cutoff_date: str | None = None, iso3: str | None = None) -> DataFrame:
    """Counts per region and period, all regions, with periods to come."""
    counted = panel.aggregate_cases(cases, freq=freq, cutoff_date=cutoff_date)
    full = panel.add_future(panel.pad_regions(counted, regions, iso3), future, freq)
    name = {"M": "cases_per_month", "D": "cases_per_day"}.get(freq, "cases_per_week")
    return read_table(cases.sparkSession, write_table(full, f"{path}/{name}"))


def build_model_input(cases: DataFrame, registry: SourceRegistry, path: str, train_end: str | None = None,
                      requests: Sequence[str] = ("worldclim.*", "edo.spi6", "noaa.oni", "worldpop.pop_count")) -> DataFrame:
    """Covariates and features, holes filled, checked for nulls and missing keys."""
    spark = cases.sparkSession
    joined = read_table(spark, write_table(covariates.covariate_panel(cases, registry, requests), f"{path}/cases_with_climate"))
    names = features.MODEL_COVARIATES
    full = features.full_features(joined).select(DATE, "GID_1", GID_2, "future", CASES, "Log_Cases", *names)
    clean = features.sanitise_covariates(full, names, train_end, across_regions=True)
    stored = read_table(spark, write_table(clean, f"{path}/model_input_data"))
    checks.assert_no_nulls(stored, names)
    checks.assert_complete(stored)
    return stored


def run_forecasts(model_input: DataFrame, path: str, models: dict[str, dict]) -> dict[str, DataFrame]:
    """Quantile forecasts of each model (name -> options), point forecasts calibrated."""
    out = {}
    for name, options in models.items():
        df = run_model(name, model_input, path, **options)
        if "quantile" not in df.columns:
            df = calibrate.residual_quantiles(df, min_history=2)
            df = read_table(model_input.sparkSession, write_table(df, f"{path}/{name}_cases_quantiles"))
        out[name] = df
    return out


def combine_and_score(forecasts: dict[str, DataFrame], path: str, step: float = 0.05) -> DataFrame:
    """Ensemble, its weights, and the scores of all models, as stored tables."""
    mixed, weights = ensemble.create_ensemble(forecasts, step)
    spark = mixed.sparkSession
    mixed = read_table(spark, write_table(mixed, f"{path}/ensemble_cases_quantiles"))
    write_csv(ensemble.weights_wide(weights, list(forecasts)), f"{path}/ensemble_weights")
    scored = ensemble.stack_models({**forecasts, "ensemble": mixed.drop("model", "ensemble_ready")})
    scores = scoring.model_wis(scored.where(F.col(CASES).isNotNull()), QUANTILE_LEVELS)
    write_csv(scores, f"{path}/wis")
    return scores


ADJUSTED = "_adjusted"
METRICS = ("R2", "RMSE", "WIS")
PARTS = ("mean", "std", "q25", "q50", "q75")


def adjust_forecasts(forecasts: dict[str, DataFrame], embeddings: DataFrame, path: str, window: int | None = 24,
                     horizons: Sequence[int] | None = None, method: str = "pinball") -> dict[str, DataFrame]:
    """Each model's errors regressed on the region features, as stored forecasts named ``<model>_adjusted``.

    Regions without features are left out; of several vectors of one region, one stays.
    """
    out = {}
    one_each = embeddings.dropDuplicates([GID_2])
    for name, df in forecasts.items():
        known = covariates.keep_regions_with(df, one_each)
        fixed = residual_regression.residual_regression(known, one_each, method=method, window=window, horizons=horizons)
        stored = write_table(fixed, f"{path}/{name}{ADJUSTED}_cases_quantiles")
        out[name + ADJUSTED] = read_table(df.sparkSession, stored)
    return out


SCORE_TABLES = ("wis", "region_scores", "model_performance", "model_performance_regression")


def score_forecasts(forecasts: dict[str, DataFrame], path: str, tables: Sequence[str] = SCORE_TABLES) -> dict[str, DataFrame]:
    """Scores on the log1p scale as stored tables, those named and the ones they need.

    ``wis``: every forecast. ``region_scores``: R2, RMSE and mean WIS per region. ``model_performance``: how each metric
    spreads over the regions (mean, deviation, quartiles), and over all forecasts at once (``_flat``).
    ``model_performance_regression``: R2 and RMSE of regional means. RMSE is in counts throughout.
    """
    stacked = ensemble.stack_models(forecasts)
    spark = stacked.sparkSession
    rows = read_table(spark, write_table(stacked.where(F.col(CASES).isNotNull()), f"{path}/scored_cases_quantiles"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        return read_table(spark, write_table(df, f"{path}/{name}"))

    by_model = [MODEL, HORIZON]
    out = {}
    if set(tables) - {"model_performance_regression"}:
        out["wis"] = stored(scoring.model_wis(rows, QUANTILE_LEVELS), "wis")
    if {"region_scores", "model_performance"} & set(tables):
        points = scoring.point_scores(rows, keys=[*by_model, GID_2], transform=F.log1p).withColumn("RMSE", F.expm1("RMSE"))
        mean_wis = out["wis"].groupBy(*by_model, GID_2).agg(F.avg("WIS").alias("WIS"))
        out["region_scores"] = stored(points.join(mean_wis, [*by_model, GID_2], "full"), "region_scores")
    if "model_performance" in tables:
        spread = scoring.score_distribution(out["region_scores"], METRICS).groupBy(*by_model).agg(
            *[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in METRICS for p in PARTS])
        flat = scoring.point_scores(pick(rows, quantile=0.5), keys=by_model, transform=F.log1p).select(
            *by_model, F.col("R2").alias("R2_flat"), F.expm1("RMSE").alias("RMSE_flat"))
        out["model_performance"] = stored(spread.join(flat, by_model, "full"), "model_performance")
    if "model_performance_regression" in tables:
        out["model_performance_regression"] = stored(scoring.regression_table(rows), "model_performance_regression")
    return out


def change_by_horizon(performance: DataFrame, base: str, path: str) -> DataFrame:
    """Change of each metric's median over the regions, per horizon: adjusted minus base, as a stored table."""
    of = lambda name: performance.where(F.col(MODEL) == name)
    change = delta_by_horizon(of(base), of(base + ADJUSTED), [f"{m}_q50" for m in METRICS])
    return read_table(performance.sparkSession, write_table(change, f"{path}/{base}_change_by_horizon"))


def wis_change(wis: DataFrame, base: str, path: str) -> DataFrame:
    """Scores of every forecast that a model and its adjusted one both have, with counts and state, as a stored table."""
    keys = [GID_2, DATE, HORIZON]
    old, new = wis.where(F.col(MODEL) == base), wis.where(F.col(MODEL) == base + ADJUSTED)
    each = scoring.compare_scores(old, new, ["WIS"], keys).join(new.select(*keys, F.expm1(CASES).alias(CASES)), keys)
    each = each.withColumn(GID_1, F.regexp_replace(GID_2, r"\.[^.]*_", "_"))
    return read_table(wis.sparkSession, write_table(each, f"{path}/{base}_wis_change"))


def report_suspects(forecasts: dict[str, DataFrame], model_input: DataFrame, path: str, before: str,
                    limit: float = 100e6) -> dict[str, DataFrame]:
    """What to look at by hand, as stored tables: regions with missing or absurdly large predictions per model and horizon,
    and covariates that never change in a region before a date."""
    spark = model_input.sparkSession
    odd = checks.outlier_regions(ensemble.stack_models(forecasts), limit, [MODEL, HORIZON])
    names = [c for c in model_input.columns if c not in (DATE, GID_1, GID_2, "future", CASES)]
    still = checks.static_covariates(model_input, names, before)
    return {name: read_table(spark, write_table(df, f"{path}/{name}")) for name, df in (("outliers", odd), ("static_covariates", still))}
