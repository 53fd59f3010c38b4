"""Forecast models by name, and running one with its outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.functions.scalars import expm1_clipped
from epipanel.operators import backtest, baseline, boosting, samples
from epipanel.schema import CASES, PREDICTION, QUANTILE, SAMPLE
from epipanel.sources.tables import read_table, write_table

Model = Callable[..., DataFrame]

MODELS: dict[str, Model] = {
    "baseline": baseline.baseline,
    "movavg": baseline.seasonal_average,
    "sarima": backtest.seasonal_autoregression,
    "xgboost": boosting.boosted_lags,
}


def register_model(name: str, model: Model) -> None:
    MODELS[name] = model


def get_model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; have {sorted(MODELS)}")
    return MODELS[name]


def run_model(name: str, panel: DataFrame, path: str | None = None, model: Model | None = None,
              save_samples: bool = False, save_quantiles: bool = True, **options) -> DataFrame:
    """Run a model, bring it to counts and quantiles, and write what is asked for.

    Samples are saved when the model made samples, under
    ``<path>/<name>_cases_samples``; quantiles under ``..._cases_quantiles``. A
    single sample per date is its own median and stays as it is.
    """
    out = (model or get_model(name))(panel, **options)
    if CASES not in out.columns and "Log_Cases" in out.columns:
        out = out.withColumns({CASES: expm1_clipped(F.col("Log_Cases")), PREDICTION: expm1_clipped(F.col(PREDICTION))})
    if path and save_samples and SAMPLE in out.columns:
        write_table(out, f"{path}/{name}_cases_samples")
    if save_quantiles and QUANTILE not in out.columns and SAMPLE in out.columns:
        out = samples.samples_to_quantiles(out)
    if path and save_quantiles and QUANTILE in out.columns:
        written = write_table(out, f"{path}/{name}_cases_quantiles")
        return read_table(out.sparkSession, written)
    return out
