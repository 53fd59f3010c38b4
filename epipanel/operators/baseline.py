"""Native forecasters: expanding-difference baseline and seasonal moving average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.functions.periods import add_periods, align_scalar, period_end
from epipanel.operators.access import between_dates, filter_admin1
from epipanel.operators.panel import densify, merge_statuses
from epipanel.operators.prefix_order import add_history_quantiles
from epipanel.schema import (
    CASES, DATE, FUTURE, GID_2, HORIZON, PREDICTION, QUANTILE, QUANTILE_LEVELS, SAMPLE,
    literal_array, period_freq, require_columns, spread, with_period,
)
from epipanel.sources.stage import stage


def _draw_positions(levels: Sequence[float], draws: int) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Where the levels fall among evenly spaced draws.

    Returns the quantile levels of the draws needed and, per level, the
    positions of its two draws in that list and the way between them.
    """
    spots, needed = [], set()
    for q in levels:
        place = q * (draws - 1)
        low = min(int(place + 1e-12), draws - 1)
        high = min(low + 1, draws - 1)
        spots.append((low, high, max(place - low, 0.0)))
        needed.update((low, high))
    ordered = sorted(needed)
    at = {j: i for i, j in enumerate(ordered)}
    return [j / max(draws - 1, 1) for j in ordered], [(at[a], at[b], f) for a, b, f in spots]


def _between(level: Column, low: Column, high: Column, part: float | Column) -> Column:
    """Interpolated quantile of the draws around ``level``, draws below zero set to zero."""
    a = F.greatest(level + low, F.lit(0.0))
    b = F.greatest(level + high, F.lit(0.0))
    return a + (b - a) * part


def baseline(panel: DataFrame, horizon: int | Sequence[int] = 1, symmetrize: bool = True, num_samples: int = 1000,
             levels: Sequence[float] = QUANTILE_LEVELS, start_date: str | None = None,
             end_date: str | None = None) -> DataFrame:
    """Forecast from the differences seen so far, at horizons 1 to ``horizon``, or at those listed.

    For row k and h steps the differences up to row k - h - 1 (mirrored around
    zero when ``symmetrize``) give evenly spaced draws around the last known
    level. Draws are evenly spaced quantiles, so nothing is random. Where the
    level lies in the future, the median forecast for that date takes its
    place. A region's first three dates carry a null median.

    The panel is staged, so that its rows are counted: both shuffles by region, before and after the draws, make as many parts as
    the forecast needs. A region's series is as long as the calendar, and all its histories' draws come from one layout of it.
    """
    require_columns(panel, [GID_2, DATE, CASES])
    df = panel if FUTURE in panel.columns else panel.withColumn(FUTURE, F.lit(False))
    if start_date is not None or end_date is not None:
        df = between_dates(df, start_date, end_date)
    steps = range(1, horizon + 1) if isinstance(horizon, int) else list(horizon)
    df = stage(df.select(GID_2, DATE, F.col(CASES).cast("double").alias(CASES), FUTURE))
    grown = df.count() * len(steps) * len(levels)
    df = spread(df, GID_2, rows=grown)
    w = Window.partitionBy(GID_2).orderBy(DATE)
    df = df.withColumn("_k", F.row_number().over(w) - 1)
    df = df.withColumn(
        "_diff", F.when(F.col("_k") >= 1, F.coalesce(F.col(CASES) - F.lag(CASES).over(w), F.lit(0.0))))

    base = {
        h: F.when(~F.lag(FUTURE, h).over(w), F.lag(CASES, h).over(w)) for h in steps
    }
    df = df.withColumns({f"_base{h}": base[h] for h in steps})

    draw_levels, spots = _draw_positions([*levels, 0.5], num_samples)
    # mirrored differences are known by their absolute values
    pool = F.abs("_diff") if symmetrize else F.col("_diff")
    # draws from the differences up to a row; a horizon takes those of h + 1 rows before
    df = add_history_quantiles(df, [GID_2], DATE, pool, draw_levels, "_all", mirrored=symmetrize, rows=None).drop("_all_n")
    # Spark forgets the parts behind Python
    df = spread(df, GID_2, rows=grown)
    df = df.withColumns({f"_draws{h}": F.lag("_all", h + 1).over(w) for h in steps})
    whole = F.array(*[F.struct(
        F.lit(h).alias("h"), F.col(f"_base{h}").alias("base"), F.col(f"_draws{h}").alias("draws")) for h in steps])
    long = df.select(GID_2, DATE, CASES, FUTURE, "_k", F.explode(whole).alias("_s")).select(
        GID_2, DATE, CASES, FUTURE, "_k", F.col("_s.h").alias(HORIZON), F.col("_s.base").alias("_base"),
        F.col("_s.draws").alias("_draws"))

    # the two draws around each level, relative to the last level; the median's come last
    lo_mid, hi_mid, part_mid = spots[-1]
    draws = F.col("_draws")
    middle = draws[lo_mid] + (draws[hi_mid] - draws[lo_mid]) * part_mid
    drift = -middle if symmetrize else (F.col(HORIZON) - 1) * middle
    ready = draws.isNotNull() & (F.col("_k") >= 2 + F.col(HORIZON))

    def shifted(side: int) -> Column:
        places = F.array(*[F.lit(s[side]) for s in spots])
        return F.when(ready, F.transform(places, lambda i: F.get(draws, i) + F.col("_drift")))

    long = long.withColumn("_drift", drift).select(
        GID_2, DATE, CASES, FUTURE, "_k", HORIZON, "_base", shifted(0).alias("_low"), shifted(1).alias("_high"))

    # rows h apart form a chain; a row without a known level takes the median before it
    chain = Window.partitionBy(GID_2, HORIZON, F.col("_k") % F.col(HORIZON)).orderBy("_k")
    needs = F.col("_base").isNull() & (F.col("_k") >= F.col(HORIZON))
    member = needs | F.coalesce(F.lead(needs).over(chain), F.lit(False))
    links = F.collect_list(F.when(F.col("_member"), F.struct(
        F.col("_base").alias("base"), F.element_at("_low", -1).alias("low"), F.element_at("_high", -1).alias("high"))))

    def median_after(level: Column, link: Column) -> Column:
        known = F.coalesce(link["base"], level)
        median = _between(known, link["low"], link["high"], part_mid)
        return F.when(known.isNotNull() & link["low"].isNotNull(), median)

    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("_needs", needs).withColumn("_member", member)
    long = long.withColumn("_links", links.over(before))
    carried = F.when(
        F.col("_needs"), F.aggregate("_links", F.lit(None).cast("double"), median_after))
    long = long.withColumn("_level", F.coalesce("_base", carried))

    # a region's first three dates never have a forecast, so filler and forecast do not meet
    filler = F.col("_k") < 3
    nothing = F.lit(None).cast("double")
    forecast = F.arrays_zip(
        literal_array(levels).alias("q"), F.slice("_low", 1, len(levels)).alias("low"),
        F.slice("_high", 1, len(levels)).alias("high"), literal_array([f for _, _, f in spots[:-1]]).alias("part"))
    blank = F.array(F.struct(F.lit(0.5).alias("q"), nothing.alias("low"), nothing.alias("high"), nothing.alias("part")))
    long = long.withColumn("_cell", F.explode(F.when(filler, blank).when(F.col("_low").isNotNull(), forecast)))
    value = _between(F.col("_level"), F.col("_cell.low"), F.col("_cell.high"), F.col("_cell.part"))
    out = long.select(
        GID_2, DATE, HORIZON, F.col("_cell.q").alias(QUANTILE),
        F.when(~filler & F.col("_level").isNotNull(), value).alias(PREDICTION), CASES, FUTURE)
    freq = period_freq(panel)
    return with_period(out, freq) if freq else out


def sample_baseline(diffs: DataFrame, keys: Sequence[str], value: str, last_level: float, draws: int,
                    horizon: int = 1, symmetrize: bool = True) -> DataFrame:
    """Evenly spaced draws per step around one last level, for each group of differences."""
    pool = diffs.select(*keys, F.col(value).cast("double").alias("_d"))
    if symmetrize:
        pool = pool.withColumn("_d", F.explode(F.array(F.col("_d"), -F.col("_d"))))
    marks = [j / max(draws - 1, 1) for j in range(draws)]
    found = pool.groupBy(*keys).agg(
        F.percentile("_d", literal_array(marks)).alias("_draws"), F.percentile("_d", F.lit(0.5)).alias("_mid"))
    steps = found.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    drift = -F.col("_mid") if symmetrize else (F.col("step") - 1) * F.col("_mid")
    return steps.withColumn("_x", drift).select(
        *keys, "step", F.posexplode("_draws").alias(SAMPLE, "_v"), "_x"
    ).select(*keys, "step", SAMPLE, (F.lit(last_level) + F.col("_v") + F.col("_x")).alias(PREDICTION))


def seasonal_average(panel: DataFrame, start_date: str | None = None, end_date: str | None = None,
                     gid_1: Sequence[str] | None = None, years: int = 5) -> DataFrame:
    """Mean of the same month in the ``years`` years before, all of them needed.

    History is zero-filled ``years`` years back from the start. The forecast
    counts as one sample (``sample = 0``); future cases are null.
    """
    freq = period_freq(panel) or "M"
    df = merge_statuses(filter_admin1(panel, gid_1))
    span = df.agg(F.struct(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))).scalar()
    marked = with_period(df, freq)
    first = span["lo"] if start_date is None else F.greatest(align_scalar(start_date, marked), span["lo"])
    last = span["hi"] if end_date is None else F.least(align_scalar(end_date, marked), span["hi"])
    back = period_end(F.add_months(first, -12 * years), freq)
    inside = marked.where((F.col(DATE) >= back) & (F.col(DATE) <= last))
    bounds = {"lo": back, "hi": last}
    known = inside.withColumn(CASES, F.coalesce(CASES, F.lit(0)))
    grid = densify(known, freq, bounds, fill={CASES: 0})
    monthly = grid.groupBy(GID_2, F.year(DATE).alias("_y"), F.month(DATE).alias("_m")).agg(
        F.avg(CASES).alias(CASES), F.coalesce(F.bool_or(FUTURE), F.lit(False)).alias(FUTURE))
    frame = Window.partitionBy(GID_2, "_m").orderBy("_y").rowsBetween(-years, -1)
    mean = F.when(F.count(CASES).over(frame) == years, F.avg(CASES).over(frame))
    out = (
        monthly.withColumn(PREDICTION, mean)
        .withColumn(DATE, F.last_day(F.make_date("_y", "_m", F.lit(1))))
        .where(F.col(DATE) >= first)
        .select(GID_2, DATE, F.when(~F.col(FUTURE), F.col(CASES)).alias(CASES), FUTURE, PREDICTION,
                F.lit(0).alias(SAMPLE))
    )
    return with_period(out, "M")


def shift_dates(df: DataFrame, n: int, freq: str = "M") -> DataFrame:
    """Move every date by ``n`` periods."""
    return df.withColumn(DATE, add_periods(F.col(DATE), n, freq))
