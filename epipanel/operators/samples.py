"""Forecast draws to quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.operators.access import filter_admin1
from epipanel.operators.quantiles import exact_quantiles
from epipanel.schema import (
    CASES, DATE, GID_2, HORIZON, MODEL, PREDICTION, QUANTILE, QUANTILE_LEVELS, literal_array,
)


def series_keys(df: DataFrame) -> list[str]:
    """Keys of one forecast series: model and horizon where there are such columns, and region."""
    return [c for c in (MODEL, HORIZON) if c in df.columns] + [GID_2]


def quantiles_of(x: Column, levels: Sequence[float] = QUANTILE_LEVELS) -> Column:
    """Aggregate: quantiles of one column, for groups known to be small."""
    return F.percentile(x, literal_array(levels))


def samples_to_quantiles(df: DataFrame, levels: Sequence[float] = QUANTILE_LEVELS,
                         gid_1: Sequence[str] | None = None, trim: bool = True) -> DataFrame:
    """Quantiles of the draws per series and date; null and NaN draws do not count.

    A date with no other draws has null quantiles. With ``trim`` the first two
    dates and the last date of each series go.
    """
    keys = series_keys(df)
    rows = filter_admin1(df, gid_1)
    out = exact_quantiles(rows, [*keys, DATE], PREDICTION, levels, [CASES])
    out = out.withColumnRenamed("value", PREDICTION)
    if not trim:
        return out
    series = Window.partitionBy(*keys)
    inner = out.withColumns({
        "_up": F.dense_rank().over(series.orderBy(F.col(DATE))),
        "_down": F.dense_rank().over(series.orderBy(F.desc(DATE))),
    })
    return inner.where("_up > 2 and _down > 1").drop("_up", "_down")


def median_of_samples(df: DataFrame) -> DataFrame:
    """Median draw per series and date."""
    out = exact_quantiles(df, [*series_keys(df), DATE], PREDICTION, [0.5])
    return out.drop(QUANTILE).withColumnRenamed("value", PREDICTION)


def widen(df: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Quantile rows to one column per level, labelled ``Log_Cases.q<level * 1000>``."""
    keys = [*series_keys(df), DATE]
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.round(QUANTILE, 6) == round(q, 6), F.col(PREDICTION))).alias(f"Log_Cases.q.{round(q * 1000):03d}")
        for q in levels
    ])


def melt_quantiles(df: DataFrame, keys: Sequence[str], back_transform: bool = True) -> DataFrame:
    """Columns labelled ``...<level * 1000>`` to rows of ``quantile`` and ``prediction``."""
    from epipanel.functions.scalars import expm1_clipped, quantile_of_label

    values = [c for c in df.columns if c not in keys]
    long = df.select(*keys, *[F.col(f"`{c}`").alias(c.replace(".", "__")) for c in values])
    long = long.unpivot(list(keys), [c.replace(".", "__") for c in values], "_label", "_value")
    label = F.regexp_replace(F.replace(F.col("_label"), F.lit("__"), F.lit(".")), r"q(?=\d+$)", "")
    value = F.col("_value")
    return long.select(
        *keys, quantile_of_label(label).alias(QUANTILE),
        (expm1_clipped(value) if back_transform else value).alias(PREDICTION),
    )
