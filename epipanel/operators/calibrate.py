"""Distributions around point forecasts, and quantile order repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epipanel.functions.periods import period_index
from epipanel.functions.scalars import expm1_clipped
from epipanel.operators.access import pick
from epipanel.operators.prefix_order import add_history_quantiles
from epipanel.operators.quantiles import prefix_quantiles, recent_quantiles
from epipanel.operators.samples import series_keys
from epipanel.operators.scoring import forecast_keys
from epipanel.schema import CASES, DATE, GID_2, HORIZON, PREDICTION, QUANTILE, QUANTILE_LEVELS, literal_array, spread
from epipanel.sources.stage import stage


def residual_quantiles(df: DataFrame, levels: Sequence[float] = QUANTILE_LEVELS, window: int | None = None,
                       min_history: int = 20, pool: bool = True) -> DataFrame:
    """Predictive distribution of point forecasts from their past errors.

    The error is log1p(truth) - log1p(prediction). Per series the errors
    strictly before a date (all, or the last ``window``) give the quantiles.
    With fewer than ``min_history`` of them the errors of all regions before
    that date do, when these are enough; else every level equals the point
    forecast. Expects one row per series and date. With ``pool`` the errors
    are staged as a table first.
    """
    if HORIZON not in df.columns:
        df = df.withColumn(HORIZON, F.lit(1))
    keys = series_keys(df)
    shared = [k for k in keys if k != GID_2]
    marks = literal_array(levels)
    point = F.log1p(F.col(PREDICTION).cast("double"))
    df = stage(df)  # read twice: for the check and for the rows
    rows = df.where(F.col(DATE).isNotNull() & (df.agg(F.count(PREDICTION)).scalar() > 0)).select(
        *keys, DATE, F.col(CASES).cast("double").alias(CASES), point.alias("_base"),
        (F.log1p(F.col(CASES).cast("double")) - point).alias("_e"),
        period_index(F.col(DATE), "D").alias("_t"),
    )
    rows = add_history_quantiles(rows, keys, "_t", "_e", levels, "_own", before=True, most=window,
                                 rows=df.count() * len(levels))
    rows = rows.withColumn("_own", F.when(F.col("_own_n") >= min_history, F.col("_own"))).drop("_own_n")
    if pool:
        # the pool reads these rows several times
        rows = stage(rows)
    cells = F.when(F.col("_own").isNotNull(), F.arrays_zip(marks.alias("q"), F.col("_own").alias("e"))).otherwise(
        F.transform(marks, lambda q: F.struct(q.alias("q"), F.lit(None).cast("double").alias("e"))))
    long = rows.withColumn("_cell", F.explode(cells)).select(
        *keys, DATE, CASES, "_base", "_t", F.col("_cell.q").alias(QUANTILE), F.col("_cell.e").alias("_e"))
    if pool:
        sparse = rows.where(F.col("_own").isNull()).select(*shared, "_t")
        if window is None:
            pooled = prefix_quantiles(rows, shared, "_t", "_e", sparse, levels)
        else:
            pooled = recent_quantiles(rows, shared, "_t", GID_2, "_e", sparse, window, levels)
        pooled = pooled.where((F.col("n") >= min_history) & (F.col("n") > 0)).select(
            *shared, "_t", QUANTILE, F.col("value").alias("_pooled"))
        long = long.join(pooled, [*shared, "_t", QUANTILE], "left")
        long = long.withColumn("_e", F.coalesce("_e", "_pooled"))
    value = F.col("_base") + F.coalesce(F.col("_e"), F.lit(0.0))
    return long.select(
        *keys, DATE, QUANTILE, expm1_clipped(value).alias(PREDICTION), CASES)


def calibrate_forecast(df: DataFrame, **options) -> DataFrame:
    """Distribution around a forecast: of a quantile forecast the median counts."""
    return residual_quantiles(pick(df, quantile=0.5) if QUANTILE in df.columns else df, **options)


def monotone_quantiles(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Lift quantiles to the running maximum of the levels below."""
    keys = list(keys) if keys is not None else forecast_keys(df)
    w = Window.partitionBy(*keys).orderBy(QUANTILE).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(PREDICTION, F.when(F.col(PREDICTION).isNotNull(), F.max(PREDICTION).over(w)))


def lift_tiny_violations(df: DataFrame, tolerance: float = 1e-8, keys: Sequence[str] | None = None) -> DataFrame:
    """Lift a quantile to the one below it when it falls short by at most ``tolerance``.

    Larger drops stay as they are. The repaired value counts as the one below
    for the next level, so the levels are walked in order.
    """
    keys = list(keys) if keys is not None else forecast_keys(df)
    others = [c for c in df.columns if c not in (*keys, QUANTILE, PREDICTION)]
    w = Window.partitionBy(*keys).orderBy(QUANTILE).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct(F.col(PREDICTION).alias("p"))).over(w)

    def walk(last, item):
        p = item["p"]
        lift = (p < last) & (last - p <= F.lit(tolerance))
        return F.when(lift, last).otherwise(p)

    fixed = F.aggregate(F.col("_seen"), F.lit(None).cast("double"), walk)
    return df.withColumn("_seen", seen).withColumn(PREDICTION, fixed).select(*keys, QUANTILE, PREDICTION, *others)


def mean_shift(df: DataFrame, biases: DataFrame) -> DataFrame:
    """Add a region's bias to all its predictions."""
    return df.join(biases, GID_2, "left").withColumn(
        PREDICTION, F.col(PREDICTION) + F.coalesce(F.col("bias"), F.lit(0.0))).drop("bias")
