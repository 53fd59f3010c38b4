"""Forecast scores: weighted interval score, R2, RMSE, pinball loss."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.functions.scalars import is_finite, pinball, to_number
from epipanel.operators.access import filter_equal, pick
from epipanel.operators.quantiles import exact_quantiles
from epipanel.schema import CASES, DATE, GID_2, HORIZON, MODEL, PREDICTION, QUANTILE
from epipanel.sources.stage import stage

Transform = Callable[[Column], Column]


def forecast_keys(df: DataFrame) -> list[str]:
    """Keys of one forecast: model and horizon where there are such columns, region, date."""
    return [c for c in (MODEL, HORIZON) if c in df.columns] + [GID_2, DATE]


def _prepared(df: DataFrame, pred: str, truth: str, transform: Transform | None,
              log1p_scale: bool, clamp: bool, keys: Sequence[str], levels: Sequence[float] = ()) -> DataFrame:
    p, y = to_number(F.col(pred)), to_number(F.col(truth))
    if transform is not None:
        p, y = transform(p), transform(y)
    elif clamp and not log1p_scale:
        p = F.when(p.isNotNull(), F.greatest(p, F.lit(0.0)))
    if log1p_scale:
        p, y = F.when(p.isNotNull(), F.log1p(F.greatest(p, F.lit(0.0)))), F.log1p(y)
    level = to_number(F.col(QUANTILE))
    q = F.round(level, 6)
    if levels:  # rounded already; rounding goes through decimals and costs more than the rest of the row
        q = F.when(level.isin(*levels), level).otherwise(q)
    return df.select(*keys, q.alias("_q"), p.alias("_p"), y.alias("_y"))


def wis(df: DataFrame, pred: str = PREDICTION, truth: str = CASES, keys: Sequence[str] | None = None,
        transform: Transform | None = None, df_filter: dict[str, Any] | None = None,
        log1p_scale: bool = False, clamp: bool = True, monotone: bool = True) -> DataFrame:
    """Weighted interval score of every forecast.

    A level counts when its complement is there too, 0.5 always. For such
    levels the score is a sum of pinball losses,
    sum(pinball) / (0.5 + sum of the levels below 0.5), because q times the
    interval score of a pair equals the two pinball losses. A missing median
    is interpolated; without a level on each side there is no score. The
    window, both groupings and the division share one shuffle by forecast.
    """
    keys = list(keys) if keys is not None else forecast_keys(df)
    rows = _prepared(filter_equal(df, df_filter), pred, truth, transform, log1p_scale, clamp, keys)
    forecast = Window.partitionBy(*keys)
    if monotone:
        upto = forecast.orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_p", F.when(F.col("_p").isNotNull(), F.max("_p").over(upto)))
    below, above = F.col("_q") < 0.5, F.col("_q") > 0.5
    pairs = rows.groupBy(*keys, F.round(F.least(F.col("_q"), 1 - F.col("_q")), 6).alias("_pair")).agg(
        F.max("_y").alias("_y"),
        F.max(F.when(below, F.col("_q"))).alias("_lo"), F.max(F.when(above, F.col("_q"))).alias("_hi"),
        F.max(F.when(below, F.col("_p"))).alias("_plo"), F.max(F.when(above, F.col("_p"))).alias("_phi"),
        F.sum(pinball(F.col("_y"), F.col("_p"), F.col("_q"))).alias("_loss"),
        F.count_if(F.col("_p").isNull() | F.col("_y").isNull()).alias("_nulls"),
    )
    median = F.col("_pair") == 0.5
    kept = median | (F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    both = kept & ~median
    scored = pairs.groupBy(*keys).agg(
        F.max("_y").alias("_y"), F.bool_or(median).alias("_has_median"),
        F.sum(F.when(kept, F.col("_loss"))).alias("_loss"),
        F.coalesce(F.sum(F.when(both, F.col("_pair"))), F.lit(0.0)).alias("_w"),
        F.coalesce(F.sum(F.when(kept, F.col("_nulls"))), F.lit(0)).alias("_nulls"),
        F.max_by(F.struct("_lo", "_plo"), F.col("_lo")).alias("_l"),
        F.min_by(F.struct("_hi", "_phi"), F.col("_hi")).alias("_h"),
    )
    mid = F.col("_l._plo") + (F.col("_h._phi") - F.col("_l._plo")) * (
        (F.lit(0.5) - F.col("_l._lo")) / (F.col("_h._hi") - F.col("_l._lo")))
    loss = F.when(F.col("_has_median"), F.col("_loss")).otherwise(
        F.coalesce(F.col("_loss"), F.lit(0.0)) + 0.5 * F.abs(F.col("_y") - mid))
    score = F.when(F.col("_nulls") == 0, loss / (F.lit(0.5) + F.col("_w")))
    return scored.select(*keys, score.alias("WIS"), F.col("_y").alias(truth))


def wis_at_levels(df: DataFrame, levels: Sequence[float], pred: str = PREDICTION, truth: str = CASES,
                  keys: Sequence[str] | None = None, transform: Transform | None = None,
                  log1p_scale: bool = False, clamp: bool = True) -> DataFrame:
    """Weighted interval score over a known list of levels that includes 0.5.

    All levels become columns of one hash aggregate, combined before the
    shuffle and never sorted: the cheap way for standard forecast tables.
    Other levels of the data are left out; a missing level gives no score.
    """
    keys = list(keys) if keys is not None else forecast_keys(df)
    levels = sorted(round(q, 6) for q in levels)
    if 0.5 not in levels:
        raise ValueError("levels must include 0.5")
    rows = _prepared(df, pred, truth, transform, log1p_scale, clamp, keys, levels)
    wide = rows.where(F.col("_q").isin(*levels)).groupBy(*keys).agg(
        F.max("_y").alias("_y"),
        *[F.max(F.when(F.col("_q") == q, F.col("_p"))).alias(f"_p{i}") for i, q in enumerate(levels)])
    used = [(i, q) for i, q in enumerate(levels) if q == 0.5 or round(1 - q, 6) in levels]
    weight = 0.5 + sum(q for _, q in used if q < 0.5)
    complete = F.col("_y").isNotNull()
    for i, _ in used:
        complete = complete & F.col(f"_p{i}").isNotNull()
    # each level's largest so far and the loss so far are columns, so that no expression repeats those before it
    wide = wide.select(*keys, "_y", complete.alias("_complete"), *[f"_p{i}" for i in range(len(levels))], F.lit(0.0).alias("_loss"))
    for i, q in enumerate(levels):
        if i:
            wide = wide.withColumn(f"_p{i}", F.greatest(f"_p{i - 1}", f"_p{i}"))
        if (i, q) in used:
            wide = wide.withColumn("_loss", F.col("_loss") + pinball(F.col("_y"), F.col(f"_p{i}"), q))
    return wide.select(*keys, F.when(F.col("_complete"), F.col("_loss") / weight).alias("WIS"), F.col("_y").alias(truth))


def _pairs(df: DataFrame, pred: str, truth: str, transform: Transform | None,
           df_filter: dict[str, Any] | None, keys: Sequence[str]) -> DataFrame:
    rows = filter_equal(df, df_filter)
    if keys and QUANTILE in df.columns:
        rows = pick(rows, quantile=0.5)
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    rows = rows.where(is_finite(y) & is_finite(p))
    if transform is not None:
        y, p = transform(y), transform(p)
    return rows.select(*keys, y.alias("_y"), p.alias("_p")).where(
        is_finite(F.col("_y")) & is_finite(F.col("_p")))


def _r2() -> Column:
    miss = F.col("_y") - F.col("_p")
    return 1 - F.sum(miss * miss) / F.nullif(F.var_pop("_y") * F.count("_y"), F.lit(0.0))


def _rmse() -> Column:
    miss = F.col("_y") - F.col("_p")
    return F.sqrt(F.avg(miss * miss))


def r2(df: DataFrame, pred: str = PREDICTION, truth: str = CASES, keys: Sequence[str] = (),
       transform: Transform | None = None, df_filter: dict[str, Any] | None = None) -> DataFrame:
    """1 - residual / total sum of squares over finite pairs; per group the median forecast counts."""
    return _pairs(df, pred, truth, transform, df_filter, keys).groupBy(*keys).agg(_r2().alias("R2"))


def rmse(df: DataFrame, pred: str = PREDICTION, truth: str = CASES, keys: Sequence[str] = (),
         transform: Transform | None = None, df_filter: dict[str, Any] | None = None) -> DataFrame:
    """Root mean squared error over finite pairs, grouped like :func:`r2`."""
    return _pairs(df, pred, truth, transform, df_filter, keys).groupBy(*keys).agg(_rmse().alias("RMSE"))


def point_scores(df: DataFrame, pred: str = PREDICTION, truth: str = CASES, keys: Sequence[str] = (),
                 transform: Transform | None = None) -> DataFrame:
    """R2 and RMSE from one pass."""
    return _pairs(df, pred, truth, transform, None, keys).groupBy(*keys).agg(
        _r2().alias("R2"), _rmse().alias("RMSE"))


def mean_pinball(df: DataFrame, keys: Sequence[str] = (), pred: str = PREDICTION, truth: str = CASES) -> DataFrame:
    """Mean pinball loss per level, added up over the levels."""
    per_level = df.dropna(subset=[pred, truth]).groupBy(*keys, QUANTILE).agg(
        F.avg(pinball(F.col(truth).cast("double"), F.col(pred), F.col(QUANTILE))).alias("_l"))
    return per_level.groupBy(*keys).agg(F.sum("_l").alias("loss"))


def regional_mean(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean truth and prediction over the regions, per date."""
    return df.groupBy(*keys, DATE).agg(F.avg(CASES).alias(CASES), F.avg(PREDICTION).alias(PREDICTION))


def regression_table(forecasts: DataFrame) -> DataFrame:
    """R2 and back-transformed RMSE per model and horizon, of log1p regional means."""
    keys = [MODEL, HORIZON]
    means = regional_mean(pick(forecasts, quantile=0.5), keys)
    return point_scores(means, keys=keys, transform=F.log1p).withColumn("RMSE", F.expm1("RMSE"))


def model_wis(forecasts: DataFrame, levels: Sequence[float] | None = None) -> DataFrame:
    """Scores of all models and horizons on the log1p scale, in one pass."""
    if levels is not None:
        return wis_at_levels(forecasts, levels, transform=F.log1p)
    return wis(forecasts, transform=F.log1p)


def score_distribution(scores: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (MODEL, HORIZON)) -> DataFrame:
    """Mean, spread and quartiles of each metric over the regions, one row per metric.

    The scores are read twice and written once, so that what stands before them runs once.
    """
    keys = list(keys)
    long = stage(scores.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])).unpivot(
        keys, list(metrics), "metric", "value").where(is_finite(F.col("value")))
    group = [*keys, "metric"]
    at = lambda q: F.max(F.when(F.col(QUANTILE) == q, F.col("value")))
    quartiles = exact_quantiles(long, group, "value", [0.25, 0.5, 0.75]).groupBy(*group).agg(
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    moments = long.groupBy(*group).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return moments.join(quartiles, group)


def compare_scores(base: DataFrame, adjusted: DataFrame, metrics: Sequence[str],
                   keys: Sequence[str] = (GID_2, DATE, HORIZON)) -> DataFrame:
    """Adjusted minus base per key, with the sign of the change."""
    b, a = base.alias("b"), adjusted.alias("a")
    both = b.select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics]).join(
        a.select(*keys, *[F.col(m).alias(f"{m}_adjusted") for m in metrics]), list(keys))
    for m in metrics:
        delta = F.col(f"{m}_adjusted") - F.col(f"{m}_base")
        both = both.withColumns({f"delta_{m}": delta, f"sign_{m}": F.signum(delta)})
    return both


def mean_wis_by_region(compared: DataFrame) -> DataFrame:
    """Mean base and adjusted score per region."""
    return compared.groupBy(GID_2).agg(F.avg("WIS_base").alias("WIS_base"), F.avg("WIS_adjusted").alias("WIS_adjusted"))
