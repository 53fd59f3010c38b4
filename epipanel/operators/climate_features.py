"""Features of the climate-driven incidence model: indices, differences, RSI, spline bases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from epipanel.functions.scalars import incidence_rate, population_offset, season_flag
from epipanel.functions.splines import add_natural_basis, fit_knots
from epipanel.operators.features import by_region, lag, rolling
from epipanel.operators.regions import region_codes, time_index
from epipanel.operators.scan import affine_scan
from epipanel.schema import CASES, DATE, GID_2


def add_rsi(df: DataFrame, name: str, column: str, n: int = 3) -> DataFrame:
    """Add the relative strength index over ``n`` changes, smoothed the Wilder way.

    Starts with the plain mean of the first ``n`` changes. Without any loss it is 100, without any change null. Changes are between values
    that are there; the smoothed rises and falls are scans of affine maps.
    """
    w = by_region()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_rsi_x", F.col(column).cast("double"))
    df = df.withColumn("_rsi_d", F.col("_rsi_x") - F.last("_rsi_x", ignorenulls=True).over(past))
    df = df.withColumn("_rsi_k", F.count("_rsi_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # running sum / n before n changes; afterwards the mean moves by 1/n of the new change
    keep = F.when(F.col("_rsi_k") <= n, 1.0).otherwise((n - 1) / n)
    change = F.col("_rsi_d")
    df = affine_scan(df, [GID_2], DATE, {
        "_rsi_up": (keep, F.greatest(change, F.lit(0.0) * change) / n), "_rsi_down": (keep, F.greatest(-change, F.lit(0.0) * change) / n)})
    total = F.col("_rsi_up") + F.col("_rsi_down")
    value = F.when(F.col("_rsi_x").isNotNull() & (F.col("_rsi_k") >= n) & (total > 0), F.lit(100.0) * F.col("_rsi_up") / total)
    return df.withColumn(name, value).drop("_rsi_x", "_rsi_d", "_rsi_k", "_rsi_up", "_rsi_down")


def year_on_year(df: DataFrame, column: str = "DIR") -> DataFrame:
    """Difference to the year before, and its lag.

    A missing past value counts as 0; where the current one is missing, the
    value 12 months ahead takes the place of the past one.
    """
    w = by_region()
    df = df.withColumn("HISTORICAL_DIR", F.coalesce(F.lag(column, 12).over(w), F.lit(0.0)))
    ahead = F.lead(column, 12).over(w)
    df = df.withColumn("DIFF_WITH_HISTORICAL_DIR", F.coalesce(
        F.col(column) - F.col("HISTORICAL_DIR"), F.col(column) - ahead))
    return df.withColumn("MODIFIED_DIFF_WITH_HISTORICAL_DIR_LAG", F.coalesce(
        F.lag("DIFF_WITH_HISTORICAL_DIR", 1).over(w), F.lit(0.0)))


def rsi_features(df: DataFrame, column: str = "DIR", n: int = 3) -> DataFrame:
    """RSI of a column (0 where there is none), its lag and the lag squared."""
    w = by_region()
    df = add_rsi(df, "RSI_DIR", column, n).withColumn("RSI_DIR", F.coalesce("RSI_DIR", F.lit(0.0)))
    df = df.withColumn("RSI_DIR_LAG", F.coalesce(F.lag("RSI_DIR", 1).over(w), F.lit(0.0)))
    return df.withColumn("SQ_RSI_DIR_LAG", F.col("RSI_DIR_LAG") * F.col("RSI_DIR_LAG"))


def climate_lags(df: DataFrame) -> DataFrame:
    """Two-month means of climate with lags 1-4, drought lags 1-2, ocean index lags 1-4."""
    w = by_region()
    df = df.withColumns({f"{c}_roll_2": rolling(F.col(c), w, 2) for c in ("tmin", "prec")})
    return df.withColumns({
        **{f"{c}_roll_2_lag{k}": lag(F.col(f"{c}_roll_2"), w, k) for c in ("tmin", "prec") for k in range(1, 5)},
        **{f"SPI6_lag{k}": lag(F.col("SPI6"), w, k) for k in (1, 2)},
        **{f"TotalONI_lag{k}": lag(F.col("TotalONI"), w, k) for k in range(1, 5)},
    })


def basis_prefixes() -> dict[str, str]:
    """Lagged climate columns and the prefixes of their spline columns."""
    out = {f"{c}_roll_2_lag{k}": f"{c}_roll_2_basis_lag{k}" for c in ("tmin", "prec") for k in range(1, 5)}
    out.update({f"SPI6_lag{k}": f"spi_basis_lag{k}" for k in (1, 2)})
    out.update({f"TotalONI_lag{k}": f"icen_basis_lag{k}" for k in range(1, 5)})
    return out


def forecast_origin(df: DataFrame, target_date: str | None = None) -> DataFrame:
    """One row: index of the last known period (or of a given date), and its forecast date.

    Expects the ``TIME`` index of :func:`time_index`.
    """
    if target_date is None:
        out = df.agg((F.min(F.when(F.col(CASES).isNull(), F.col("TIME"))) - 1).alias("origin"),
                     F.min(F.when(F.col(CASES).isNull(), F.col(DATE))).alias("forecast_date"))
        return out
    day = F.lit(target_date).cast("date")
    return df.agg(F.max(F.when(F.col(DATE) == day, F.col("TIME"))).alias("origin"), day.alias("forecast_date"))


def offsets_at_origin(df: DataFrame, target_date: str | None = None) -> DataFrame:
    """Population offset of every region at the origin, else the latest known one."""
    origin = forecast_origin(df, target_date).select("origin").scalar()
    return df.withColumn("_o", origin).groupBy(GID_2).agg(
        F.coalesce(
            F.max(F.when(F.col("TIME") == F.col("_o"), F.col("POP_OFFSET"))),
            F.max_by("POP_OFFSET", "TIME")).alias("POP_OFFSET"))


def climate_feature_table(df: DataFrame, summer: Sequence[int] = (12, 1, 2, 3, 4), bases: bool = True) -> DataFrame:
    """Covariate panel to the feature table of the climate model.

    With ``bases`` one job finds the spline knots first.
    """
    out = time_index(df).join(region_codes(df), GID_2)
    out = out.withColumns({
        "MONTH": F.month(DATE), "YEAR": F.year(DATE),
        "POP_OFFSET": population_offset(F.col("pop_count")),
        "DIR": incidence_rate(F.col(CASES), F.col("pop_count")),
        "SEASON": season_flag(F.col(DATE), tuple(summer)),
    })
    out = climate_lags(rsi_features(year_on_year(out)))
    if not bases:
        return out
    prefixes = basis_prefixes()
    sizes = {**{c: 2 for c in prefixes}, "MODIFIED_DIFF_WITH_HISTORICAL_DIR_LAG": 4}
    return add_natural_basis(out, fit_knots(out, sizes), prefixes)
