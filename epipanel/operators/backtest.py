"""Rolling-origin forecasts: refit at each origin, score the last point of each horizon."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epipanel.functions.periods import align_scalar, period_index
from epipanel.functions.scalars import expm1_clipped
from epipanel.operators.checks import active_regions
from epipanel.schema import CASES, DATE, FUTURE, GID_1, GID_2, HORIZON, PREDICTION, period_freq, require_columns, spread
from epipanel.sources.stage import stage

LOG_CASES = "Log_Cases"
_GROUPS: dict[int, Callable[[], Column]] = {
    0: lambda: F.lit("all"), 1: lambda: F.col(GID_1), 2: lambda: F.col(GID_2)}


def training_regions(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Panel rows of the regions with any case in the training window."""
    active = active_regions(panel, start, end).where("active").select(GID_2)
    return panel.join(active, GID_2, "left_semi")


def _timed(panel: DataFrame, freq: str) -> DataFrame:
    df = panel if LOG_CASES in panel.columns else panel.withColumn(LOG_CASES, F.log1p(CASES))
    df = df if FUTURE in df.columns else df.withColumn(FUTURE, F.lit(False))
    return df.withColumn("_t", period_index(F.col(DATE), freq))


def _fit_time(origin: Column, first: Column, every: int) -> Column:
    """Time of the fit in force at an origin when refitting every ``every`` periods."""
    return (first + F.floor((origin - first) / every) * every).cast("int")


def _solve_batch(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    """Least squares from normal equations, row by row in one batch; null when singular."""
    if not len(xty):
        return pd.Series([], dtype=object)
    b = np.stack(xty.to_numpy())
    p = b.shape[1]
    a = np.stack(xtx.to_numpy()).reshape(-1, p, p)
    good = np.linalg.cond(a) < 1e12
    out = np.zeros_like(b)
    if good.any():
        out[good] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
    return pd.Series([row.tolist() if ok else None for row, ok in zip(out, good)])


_solve = F.pandas_udf(_solve_batch, T.ArrayType(T.DoubleType()))


def seasonal_lags(horizon: int, season: int = 12) -> list[int]:
    """Lags known ``horizon`` ahead: the latest value, last season's, and the one before that."""
    back = season * -(-horizon // season)
    return [horizon, back, back + horizon]


def seasonal_autoregression(panel: DataFrame, horizons: Sequence[int] = (1,), season: int = 12, level: int = 2,
                            retrain: int = 1, start_date: str | None = None, train_start: str | None = None,
                            train_end: str | None = None, covariates: Sequence[str] = ()) -> DataFrame:
    """Point forecasts by least squares on seasonal lags of log cases, refit over time.

    Each fit uses all rows up to its origin. The normal equations are sums, so
    a running total over time gives every fit in one pass. The horizon is one of the keys. ``level`` pools the
    fit over the country (0), the state (1) or keeps it per region (2).
    ``retrain`` is the number of periods between fits; 0 fits once, at
    ``train_end``. ``covariates`` enter with their value at the origin. Regions without cases in training, rows with a missing
    lag or covariate, and fits that cannot be solved, give no forecast.
    """
    if level not in _GROUPS:
        raise ValueError(f"level must be 0, 1 or 2, not {level}")
    freq = period_freq(panel) or "M"
    df = _timed(training_regions(panel, train_start, train_end), freq).withColumn("_g", _GROUPS[level]())
    series = Window.partitionBy(GID_2).orderBy("_t")
    cells = [F.struct(F.lit(h).alias("h"), F.array(F.lit(1.0), *[F.lag(LOG_CASES, k).over(series) for k in seasonal_lags(h, season)],
                                                   *[F.lag(F.col(c).cast("double"), h).over(series) for c in covariates]).alias("x"))
             for h in horizons]
    rows = df.select(GID_2, DATE, CASES, FUTURE, "_t", "_g", F.col(LOG_CASES).alias("_y"), F.array(*cells).alias("_cells"))
    rows = rows.withColumn("_cell", F.explode("_cells")).select(
        GID_2, DATE, CASES, FUTURE, "_t", "_g", "_y", F.col("_cell.h").alias("_h"), F.col("_cell.x").alias("_x"))
    rows = stage(rows.where(~F.exists("_x", lambda v: v.isNull())))  # fits and forecasts read them
    return _predict(rows, _running_fits(rows, 4 + len(covariates)), retrain, start_date, train_end, panel, freq)


def _running_fits(rows: DataFrame, p: int) -> DataFrame:
    """Coefficients per group, horizon and time, from all rows up to that time."""
    known = rows.where(F.col("_y").isNotNull() & ~F.col(FUTURE))
    x = F.col("_x")
    daily = known.groupBy("_g", "_h", "_t").agg(
        F.count("*").alias("_n"),
        *[F.sum(x[i] * x[j]).alias(f"_a{i}_{j}") for i in range(p) for j in range(i, p)],
        *[F.sum(x[i] * F.col("_y")).alias(f"_b{i}") for i in range(p)])
    past = Window.partitionBy("_g", "_h").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(past)
    sums = daily.select(
        "_g", "_h", "_t", total("_n").alias("_n"),
        F.array(*[total(f"_a{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("_xtx"),
        F.array(*[total(f"_b{i}") for i in range(p)]).alias("_xty"))
    return sums.where(F.col("_n") > p).select("_g", "_h", F.col("_t").alias("_f"), _solve("_xtx", "_xty").alias("_beta")).where(
        F.col("_beta").isNotNull())


def _predict(rows: DataFrame, fits: DataFrame, retrain: int, start_date: str | None, train_end: str | None, panel: DataFrame,
             freq: str) -> DataFrame:
    bounds = rows.groupBy("_h").agg(F.min("_t").alias("_lo"), F.max(F.when(~F.col(FUTURE), F.col("_t"))).alias("_hi"))
    timed, h = rows.join(bounds, "_h"), F.col("_h")
    first = period_index(align_scalar(start_date, panel), freq) if start_date else F.col("_lo")
    if start_date:
        timed = timed.where(F.col("_t") >= first)
    if retrain:
        fit = F.least(_fit_time(F.col("_t") - h, first - h, retrain), F.col("_hi"))
    else:
        fit = period_index(align_scalar(train_end, panel), freq) if train_end else F.col("_hi") - h
    due = timed.withColumn("_f", fit.cast("int"))
    # a fit time without rows of its own takes the latest fit before it
    keys = ["_g", "_h"]
    ends = fits.withColumn("_until", F.lead("_f").over(Window.partitionBy(*keys).orderBy("_f")))
    steps = due.select(*keys, "_f").distinct().join(ends.withColumnRenamed("_f", "_from"), keys).where(
        (F.col("_f") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("_f") < F.col("_until")))).select(
        *keys, "_f", "_beta")
    value = F.aggregate(F.zip_with("_beta", "_x", lambda b, x: b * x), F.lit(0.0), lambda s, v: s + v)
    return due.join(steps, [*keys, "_f"]).select(
        GID_2, DATE, h.alias(HORIZON), expm1_clipped(value).alias(PREDICTION), CASES)


def backtest_series(panel: DataFrame, fit: Callable[[np.ndarray], Any], predict: Callable[[Any, np.ndarray, int], float],
                    horizons: Sequence[int] = (1,), retrain: int = 1, start_date: str | None = None,
                    min_train: int = 3, train_start: str | None = None, train_end: str | None = None) -> DataFrame:
    """Rolling forecasts by any single-series forecaster, one region's series at a time.

    ``fit(history)`` gives a state and ``predict(state, history, h)`` a value,
    both on the log1p scale, history up to the origin. Works per region only:
    a series is as long as the calendar, while pooled series have no bound.
    A ValueError of the forecaster skips that fit.
    """
    require_columns(panel, [GID_2, DATE, CASES])
    freq = period_freq(panel) or "M"
    df = _timed(training_regions(panel, train_start, train_end), freq)
    df = df.select(GID_2, DATE, "_t", F.col(LOG_CASES).cast("double").alias("y"), F.col(CASES).cast("double").alias(CASES))
    if start_date is not None:
        df = df.withColumn("_due", F.col("_t") >= period_index(align_scalar(start_date, panel), freq))
    else:
        df = df.withColumn("_due", F.lit(True))
    steps = list(horizons)

    def one_region(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        y, due = pdf["y"].to_numpy(), pdf["_due"].to_numpy()
        out = []
        for h in steps:
            state, fitted = None, None
            for k in range(min_train + h - 1, len(y)):
                if not due[k] or np.isnan(y[: k - h + 1]).any():
                    continue
                try:
                    if fitted is None or (retrain and k - fitted >= retrain):
                        state, fitted = fit(y[: k - h + 1]), k
                    out.append((k, h, float(predict(state, y[: k - h + 1], h))))
                except ValueError:
                    continue
        at = [k for k, _, _ in out]
        return pd.DataFrame({
            GID_2: pdf[GID_2].to_numpy()[at], DATE: pdf[DATE].to_numpy()[at], HORIZON: [h for _, h, _ in out],
            PREDICTION: np.maximum(np.expm1([v for _, _, v in out]), 0.0) if out else np.array([], float),
            CASES: pdf[CASES].to_numpy()[at]})

    return spread(df, GID_2).groupBy(GID_2).applyInPandas(
        one_region, f"{GID_2} string, {DATE} date, {HORIZON} int, {PREDICTION} double, {CASES} double")
