"""Lag, rolling and seasonal features, each within its own region."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from epipanel.functions.periods import month_cycle
from epipanel.functions.scalars import clip, fill_null
from epipanel.operators.scan import affine_scan
from epipanel.schema import CASES, DATE, GID_2, require_columns
from epipanel.sources.stage import stage

# Rolling functions by their usual name.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median,
    "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
}


def by_region(keys: Sequence[str] = (GID_2,), order: str = DATE) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lag(x: Column, w: WindowSpec, k: int = 1) -> Column:
    """Value ``k`` rows earlier (later for negative ``k``)."""
    return x if k == 0 else F.lag(x, k).over(w)


def rolling(x: Column, w: WindowSpec, window: int, min_periods: int | None = None,
            agg: str = "mean", offset: int = 0) -> Column:
    """Aggregate over ``window`` rows that end ``offset`` rows before the current one.

    Null until ``min_periods`` (default: the whole window) values are there.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"unknown rolling aggregate {agg!r}")
    frame = w.rowsBetween(-(window - 1) - offset, -offset)
    need = window if min_periods is None else min_periods
    value = AGGREGATES[agg](x).over(frame)
    return F.when(F.count(x).over(frame) >= need, value) if need > 0 else value


def diff(x: Column, w: WindowSpec, k: int = 1) -> Column:
    return x - lag(x, w, k)


def pct_change(x: Column, w: WindowSpec, k: int = 1) -> Column:
    """Relative change; from zero there is none (null)."""
    return x / F.nullif(lag(x, w, k), F.lit(0)) - 1


def add_ema(df: DataFrame, name: str, x: Column, keys: Sequence[str], order: str, span: int) -> DataFrame:
    """Add an exponential moving average, weight 2 / (span + 1), started by the first value.

    A gap keeps the last average and fades it by the time that went by: after a gap of g rows the average counts
    ``(1 - weight)**g``. A scan of affine maps.
    """
    alpha, w = 2.0 / (span + 1.0), by_region(keys, order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_ema_x": x.cast("double"), "_ema_r": F.row_number().over(w)})
    known = F.col("_ema_x").isNotNull()
    df = df.withColumn("_ema_last", F.max(F.when(known, F.col("_ema_r"))).over(past))
    fade = F.pow(F.lit(1.0 - alpha), F.col("_ema_r") - F.col("_ema_last"))
    first = F.col("_ema_last").isNull()
    a = F.when(known, F.when(first, 0.0).otherwise(fade / (fade + alpha)))
    b = F.when(known, F.when(first, F.col("_ema_x")).otherwise(alpha * F.col("_ema_x") / (fade + alpha)))
    out = affine_scan(df, keys, order, {"_ema_m": (a, b)})
    return out.withColumn(name, F.when(~first | known, F.col("_ema_m"))).drop("_ema_x", "_ema_r", "_ema_last", "_ema_m")


def cumulative_sum(x: Column, w: WindowSpec, offset: int = 0) -> Column:
    """Running sum up to ``offset`` rows before the current one; null where the value is."""
    total = F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -offset))
    return F.when(lag(x, w, offset).isNotNull(), total)


def trend(x: Column, w: WindowSpec, window: int = 12, offset: int = 0) -> Column:
    """Least-squares slope over the last ``window`` rows, if all have values."""
    frame = w.rowsBetween(-(window - 1) - offset, -offset)
    position = F.col("_row").cast("double")
    return F.when(F.count(x).over(frame) == window, F.regr_slope(x, position).over(frame))


def _step(x: Column, w: WindowSpec | None, step: dict[str, Any]) -> Column:
    op = step["op"]
    if op in ("shift", "rolling", "diff", "pct_change", "ema") and w is None:
        raise ValueError(f"op {op!r} looks at other rows and needs 'groupby'")
    if op == "shift":
        return lag(x, w, step.get("periods", 1))
    if op == "rolling":
        return rolling(x, w, step["window"], step.get("min_periods"), step.get("agg", "mean"))
    if op == "diff":
        return diff(x, w, step.get("periods", 1))
    if op == "pct_change":
        return pct_change(x, w, step.get("periods", 1))
    if op == "fillna":
        return fill_null(x, step.get("value", 0))
    if op == "clip":
        return clip(x, step.get("lower"), step.get("upper"))
    if op == "lambda":
        return step["func"](x)
    raise ValueError(f"unknown op {op!r}")


def build_features(df: DataFrame, specs: Iterable[dict[str, Any]], order: str = DATE) -> DataFrame:
    """Add one column per spec ``{name, column, groupby?, pipeline: [{op, ...}]}``.

    A later spec sees the columns of the earlier ones. All windows of the same
    groups share one shuffle and one sort.
    """
    for spec in specs:
        require_columns(df, [spec["column"]])
        keys = spec.get("groupby")
        w = by_region(keys, order) if keys else None
        # each step goes into a column of its own: windows do not nest
        name = spec["name"]
        value = df[spec["column"]]
        for step in spec["pipeline"]:
            if step["op"] == "ema" and keys:
                df = add_ema(df, "_step", value, keys, order, step["span"])
            else:
                df = df.withColumn("_step", _step(value, w, step))
            value = F.col("_step")
        if spec["pipeline"]:
            df = df.withColumn(name, value).drop("_step")
        else:
            df = df.withColumn(name, value)
    return df


def default_covariates(df: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """Standard recipe: log cases, two-month climate means and their lags."""
    region = [GID_2]
    specs = [
        {"name": "Log_Cases", "column": CASES, "pipeline": [{"op": "lambda", "func": F.log1p}]},
        {"name": "lag_1_log_cases", "column": "Log_Cases", "groupby": region,
         "pipeline": [{"op": "shift", "periods": 1}]},
    ]
    for name in ("tmin", "prec"):
        specs += [
            {"name": f"{name}_roll_2", "column": name, "groupby": region,
             "pipeline": [{"op": "rolling", "window": 2}]},
            {"name": f"lag_1_{name}_roll_2", "column": f"{name}_roll_2", "groupby": region,
             "pipeline": [{"op": "shift", "periods": 1}]},
        ]
    out = build_features(df.withColumn("MONTH", F.month(DATE)), specs)
    return out, "Log_Cases", ["lag_1_log_cases", "lag_1_tmin_roll_2", "lag_1_prec_roll_2"]


# Columns the models take from the full feature set.
MODEL_COVARIATES = [
    "tmax_lag_0", "tmin_lag_0", "prec_lag_0", "spi6_lag_0", "oni_lag_0",
    "oni_6m_lag_0", "oni_12m_lag_0", "pop_lag_0", "log_cases_lag_1",
]


def full_features(df: DataFrame, min_periods: int | None = None, fill: float | None = None) -> DataFrame:
    """Full feature set of the monthly model.

    ``min_periods`` lets rolling columns start before their window is full;
    ``fill`` replaces the nulls left in the new columns.
    """
    w = by_region()
    need = lambda window: window if min_periods is None else min_periods
    before = list(df.columns)
    df = df.withColumn("Log_Cases", F.log1p(CASES))
    sin_month, cos_month = month_cycle(F.col(DATE))
    log_cases, oni = F.col("Log_Cases"), F.col("TotalONI")
    df = df.withColumns({
        **{f"{c}_lag_{k}": lag(F.col(c), w, k) for c in ("tmax", "tmin", "prec") for k in (0, 1, 2)},
        "spi6_lag_0": F.col("SPI6"),
        "oni_lag_0": oni,
        "oni_6m_lag_0": rolling(oni, w, 6, need(6)),
        "oni_12m_lag_0": rolling(oni, w, 12, need(12)),
        "pop_lag_0": F.col("pop_count"),
        "log_cases_lag_1": lag(log_cases, w, 1),
        "log_cases_12m_ma": rolling(log_cases, w, 12, need(12), offset=1),
        "log_cases_24m_ma": rolling(log_cases, w, 24, need(24), offset=1),
        "log_cases_48m_ma": rolling(log_cases, w, 48, need(48), offset=1),
        "log_cases_12m_cum": rolling(log_cases, w, 12, need(12), "sum", offset=1),
        "log_cases_cum": cumulative_sum(log_cases, w, offset=1),
        "_row": F.row_number().over(w),
        "sin_month": sin_month,
        "cos_month": cos_month,
    })
    df = df.withColumns({
        "log_cases_slope": diff(F.col("log_cases_lag_1"), w),
        "log_cases_12m_trend": trend(log_cases, w, 12, offset=1),
    })
    df = df.withColumns({
        "log_cases_slope_6m": rolling(F.col("log_cases_slope"), w, 6, need(6)),
        "log_cases_slope_12m": rolling(F.col("log_cases_slope"), w, 12, need(12)),
    }).drop("_row")
    if fill is not None:
        df = df.fillna(fill, subset=[c for c in df.columns if c not in before and c != "Log_Cases"])
    return df


def seasonal_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values take the region's mean of the same calendar month."""
    w = Window.partitionBy(GID_2, F.month(DATE))
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in columns})


def fill_along(df: DataFrame, columns: Sequence[str], across_regions: bool = False) -> DataFrame:
    """Forward, then backward fill within the region.

    A region without any value stays null, unless ``across_regions`` gives it
    the overall mean.
    """
    w = by_region()
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead))
        for c in columns
    })
    if across_regions:
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
        df = df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})
    return df


def scale_factors(df: DataFrame, columns: Sequence[str], before: str | None) -> Column:
    """Mean absolute value of each column before a date (default: before the last one)."""
    if before is None:
        early = df.where(F.col(DATE) < df.agg(F.max(DATE)).scalar())
    else:
        early = df.where(F.col(DATE) < F.lit(before).cast("date"))
    return early.agg(F.struct(*[F.avg(F.abs(F.col(c))).alias(c) for c in columns])).scalar()


def sanitise_covariates(df: DataFrame, columns: Sequence[str], start_date: str | None = None,
                        across_regions: bool = False, check: bool = True) -> DataFrame:
    """Fill the holes of covariates and bring them to a mean absolute value of 1.

    A column whose mean absolute value is at most 0.001 keeps its scale.
    ``check`` raises when a null is left. The filled table is staged: the scales and the rows read it.
    """
    filled = stage(fill_along(seasonal_fill(df, columns), columns, across_regions))
    norms = scale_factors(filled, columns, start_date)
    out = filled.withColumn("_norms", norms).withColumns({
        c: F.when(F.col("_norms")[c] > 1e-3, F.col(c) / F.col("_norms")[c]).otherwise(F.col(c))
        for c in columns
    }).drop("_norms")
    if check:
        from epipanel.operators.checks import assert_no_nulls

        out = stage(out)
        assert_no_nulls(out, columns)
    return out


def pca_transform(df: DataFrame, columns: Sequence[str], keep: int = 5, cases: str = CASES) -> DataFrame:
    """Project covariates to at most ``keep`` principal components ``PC1, PC2, ...``.

    The sign of a component is free.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = min(keep, len(columns))
    # two fits and the projection read it
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(stage(df))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c").fit(vectors)
    centred = scaler.transform(vectors)
    out = PCA(k=k, inputCol="_c", outputCol="_pc").fit(centred).transform(centred)
    parts = vector_to_array("_pc")
    kept = [c for c in dict.fromkeys([DATE, GID_2, "future", CASES, cases]) if c in df.columns]
    return out.select(*kept, *[parts[i].alias(f"PC{i + 1}") for i in range(k)])


def undo_difference(df: DataFrame, column: str, keys: Sequence[str] = (GID_2,)) -> DataFrame:
    """Running sum per series: differences back to levels."""
    w = by_region(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.sum(column).over(w))
