"""Rolling-origin back-tests of forecasters that learn from pooled regions, with covariates.

A forecaster has three parts. ``learn`` turns one region's series into a vector of sums for each fit time; vectors of regions add up. ``fit`` makes a
state out of a group's total, and ``predict`` a value out of the state and the region's own history up to the origin. So a
country's fit never needs the country's series in one place:

1. Each region's series is packed into one row, as long as the calendar, and staged.
2. Tasks learn from the series they hold, all fit times at once, and add up within the task.
3. Totals per (group, fit time) are one aggregate; each is fitted by itself.
4. The group's states (fit times times the state's length) join its regions, which forecast all dates and horizons.

A group with very many regions is split over tasks in steps 2 and 4, like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.functions.periods import align_scalar, period_index
from epipanel.operators.backtest import _GROUPS, LOG_CASES, _timed, training_regions
from epipanel.schema import CASES, DATE, FUTURE, GID_2, HORIZON, PREDICTION, period_freq, spread, with_period
from epipanel.sources.stage import stage


@dataclass
class Series:
    """One region's dates, as period numbers ``t``, with log cases ``y`` (NaN: unknown) and covariates ``x`` (dates x columns)."""

    t: np.ndarray
    y: np.ndarray
    x: np.ndarray

    def upto(self, end: int) -> Series:
        n = int(np.searchsorted(self.t, end, "right"))
        return Series(self.t[:n], self.y[:n], self.x[:n])


@dataclass(frozen=True)
class Forecaster:
    learn: Callable[[Series, np.ndarray], np.ndarray]  # series, fit times -> fit times x sums, each over the history up to its time
    fit: Callable[[np.ndarray], np.ndarray]  # a group's sums -> state; ValueError: no fit
    predict: Callable[[np.ndarray, Series, int], float]  # state, history, horizon -> log cases; ValueError or NaN: no forecast


def _series(cells: list) -> Series:
    return Series(np.array([c["_t"] for c in cells], "i8"), np.array([c["y"] for c in cells], "f8"),
                  np.array([c["x"] for c in cells], "f8").reshape(len(cells), -1))


def backtest_groups(panel: DataFrame, forecaster: Forecaster, horizons: Sequence[int] = (1,), level: int = 2, covariates: Sequence[str] = (),
                    retrain: int = 1, min_train: int = 3, start_date: str | None = None, train_start: str | None = None,
                    train_end: str | None = None) -> DataFrame:
    """Forecasts of each known or future date from origins ``horizon`` before it, refitted every ``retrain`` periods.

    ``level`` pools the fit over the country (0), the state (1) or not at all (2). The first fit has ``min_train`` dates of the panel;
    with ``retrain=0`` there is one fit, at ``train_end``, else at the last known date. Cases after the origin are never seen,
    covariates neither. Regions without cases in training, and dates before the first fit, give no forecast.
    """
    freq = period_freq(panel) or "M"
    df = _timed(training_regions(panel, train_start, train_end), freq)
    known = ~F.coalesce(F.col(FUTURE), F.lit(False))
    bounds = df.agg(F.min("_t").alias("lo"), F.max(F.when(known & F.col(LOG_CASES).isNotNull(), F.col("_t"))).alias("hi"), F.first(
        period_index(align_scalar(train_end, panel), freq) if train_end else F.lit(None).cast("int")).alias("end"), F.first(
        period_index(align_scalar(start_date, panel), freq) if start_date else F.lit(None).cast("int")).alias("start")).first()
    schema = f"{GID_2} string, {DATE} date, {HORIZON} int, {PREDICTION} double, {CASES} double"
    if bounds["hi"] is None:
        return with_period(df.sparkSession.createDataFrame([], schema), freq)
    first, hi = bounds["lo"] + min_train - 1, bounds["hi"]
    ends = np.arange(first, hi + 1, retrain) if retrain else np.array([bounds["end"] if bounds["end"] is not None else hi])
    # a fit time beyond the calendar would see the last known date only
    cell = F.struct("_t", F.col(DATE).alias("d"), F.when(known, F.col(LOG_CASES)).cast("double").alias("y"), F.col(CASES).cast("double").alias("c"),
                    F.array(*[F.col(c).cast("double") for c in covariates]).cast("array<double>").alias("x"))
    packed = stage(spread(df.withColumn("_g", _GROUPS[level]()), GID_2).groupBy("_g", GID_2).agg(F.sort_array(F.collect_list(cell)).alias("s")))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(g, int(f), row.tolist()) for g, total in held.items() for f, row in zip(ends, total)], columns=["_g", "_f", "v"])

        for part in parts:
            for g, cells in zip(part["_g"], part["s"]):
                own = forecaster.learn(_series(cells), ends)
                held[g] = held[g] + own if g in held else own
                if len(held) >= 64:
                    yield told()
                    held.clear()
        if held:
            yield told()

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for g, f, v in zip(part["_g"], part["_f"], part["v"]):
                try:
                    rows.append((g, f, np.asarray(forecaster.fit(np.array(v, "f8")), "f8").tolist()))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["_g", "_f", "state"])

    sums = (packed.select("_g", "s").mapInPandas(learn, "_g string, _f long, v array<double>")
            .select("_g", "_f", F.posexplode("v").alias("i", "v")).groupBy("_g", "_f", "i").agg(F.sum("v").alias("v")))
    totals = sums.groupBy("_g", "_f").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("v"))
    states = totals.mapInPandas(fit, "_g string, _f long, state array<double>")
    by_group = stage(states.groupBy("_g").agg(F.collect_list(F.struct("_f", "state")).alias("f")))

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for gid, cells, fits in zip(part[GID_2], part["s"], part["f"]):
                series, state = _series(cells), {int(f["_f"]): np.array(f["state"], "f8") for f in fits}
                for k, t in enumerate(series.t.tolist()):
                    if bounds["start"] is not None and t < bounds["start"]:
                        continue
                    for h in horizons:
                        origin = min(t - h, hi)  # beyond the known dates the last one is the origin
                        f = int(ends[0]) if not retrain else first + (origin - first) // retrain * retrain
                        if origin < first or f not in state:
                            continue
                        try:
                            value = float(forecaster.predict(state[f], series.upto(origin), t - origin))
                        except ValueError:
                            continue
                        if np.isfinite(value):
                            rows.append((gid, cells[k]["d"], h, max(float(np.expm1(value)), 0.0), cells[k]["c"]))
            yield pd.DataFrame(rows, columns=[GID_2, DATE, HORIZON, PREDICTION, CASES])

    return with_period(packed.join(by_group, "_g").select(GID_2, "s", "f").mapInPandas(predict, schema), freq)


def seasonal_smoothing(alpha: float = 0.3, season: int = 12) -> Forecaster:
    """Exponential smoothing of what the pooled season leaves, plus the pooled effect of covariates at the origin.

    Sums per season of log cases make the profile; sums over the covariates make their slopes by least squares on log cases less the overall
    mean. The level runs through the region's own history.
    """
    def learn(series: Series, ends: np.ndarray) -> np.ndarray:
        good = ~np.isnan(series.y) & ~np.isnan(series.x).any(1)
        y, x = np.where(good, series.y, 0.0), np.where(good[:, None], series.x, 0.0)
        place = (series.t % season)[:, None] == np.arange(season)
        p = x.shape[1]
        parts = [place * good[:, None], place * y[:, None], x, (x[:, :, None] * x[:, None, :]).reshape(len(y), p * p), x * y[:, None]]
        running = np.vstack([np.zeros(2 * season + 2 * p + p * p), np.cumsum(np.hstack(parts), 0)])
        return running[np.searchsorted(series.t, ends, "right")]

    def fit(v: np.ndarray) -> np.ndarray:
        p = int(round(np.sqrt(len(v) - 2 * season + 1))) - 1
        n, y = v[:season], v[season:2 * season]
        sx, xx, xy = v[2 * season:2 * season + p], v[2 * season + p:2 * season + p + p * p].reshape(p, p), v[2 * season + p + p * p:]
        count = n.sum()
        if not count:
            raise ValueError("nothing to learn from")
        mean = y.sum() / count
        profile = np.where(n > 0, y / np.maximum(n, 1), mean)
        a, b = xx - np.outer(sx, sx) / count, xy - sx * mean
        slope = np.linalg.solve(a, b) if p and np.linalg.cond(a) < 1e10 else np.zeros(p)
        return np.concatenate([profile, slope, sx / count])

    def predict(state: np.ndarray, history: Series, h: int) -> float:
        p = (len(state) - season) // 2
        profile, slope, centre = state[:season], state[season:season + p], state[season + p:]
        rest = history.y - profile[history.t % season]
        rest = rest[~np.isnan(rest)]
        if not len(rest):
            raise ValueError("no history")
        level = rest[0]
        for e in rest[1:]:
            level = alpha * e + (1 - alpha) * level
        effect = float(slope @ (history.x[-1] - centre)) if p else 0.0
        return level + profile[(history.t[-1] + h) % season] + effect

    return Forecaster(learn, fit, predict)
