"""Boosted trees on lags, for the pinball loss: forecasts at several horizons and levels, refitted over time.

Training examples are never a table: a region's series is a few numbers per date, and the lag windows (``lags`` values of each
column) exist only inside the task that learns from them. Regions are dealt into blocks of about ``block_rows`` panel rows, and
each (block, horizon, fit time, level) is one group: its trees are learned from the block's regions and forecast these. So work is
spread over blocks, horizons, refits and levels, a task's memory is bounded, and nothing is gathered over all regions. A table of up to
``block_rows`` rows is one block, pooled over all its regions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.functions.periods import align_scalar, period_index
from epipanel.operators.backtest import LOG_CASES, _timed, training_regions
from epipanel.schema import CASES, DATE, FUTURE, GID_2, HORIZON, PREDICTION, QUANTILE, QUANTILE_LEVELS, period_freq, spread, with_period


def lower_quantile(values: np.ndarray, level: float) -> float:
    """The smallest value with at least ``level`` of the values at or below it; it minimises the pinball loss."""
    k = int(np.ceil(level * len(values) - 1e-9)) - 1
    return float(np.partition(values, max(k, 0))[max(k, 0)])


def lag_windows(series: np.ndarray, lags: int, horizon: int) -> np.ndarray:
    """Per row of ``series`` (dates x columns), the ``lags`` values of each column known ``horizon`` before it; null rows at the start."""
    out = np.full((len(series), series.shape[1] * lags), np.nan)
    first = horizon + lags - 1
    if len(series) > first:
        windows = np.lib.stride_tricks.sliding_window_view(series, lags, axis=0)  # rows, columns, lags
        out[first:] = windows[:len(series) - first].reshape(len(series) - first, -1)
    return out


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, the values that bound its bins from above: all distinct values if they are few, else evenly spaced ranks."""
    found = []
    for column in x.T:
        own = np.unique(column)
        if len(own) > bins:
            ranks = np.sort(column)[(np.arange(1, bins) * len(column)) // bins]
            own = np.append(np.unique(ranks), own[-1])
        found.append(own)
    return found


class Tree:
    """A tree over binned features, grown level by level from histograms."""

    def __init__(self, binned: np.ndarray, push: np.ndarray, features: np.ndarray, bins: int, depth: int, least: int):
        rows, node = len(binned), np.zeros(len(binned), "i8")
        self.splits: list[dict[int, tuple[int, int]]] = []
        for _ in range(depth):
            nodes = int(node.max(initial=0)) + 1
            counts, sums = np.zeros((nodes, len(features), bins)), np.zeros((nodes, len(features), bins))
            for j, f in enumerate(features.tolist()):
                place = node * bins + binned[:, f]
                counts[:, j] = np.bincount(place, minlength=nodes * bins).reshape(nodes, bins)
                sums[:, j] = np.bincount(place, push, minlength=nodes * bins).reshape(nodes, bins)
            left, pushed = counts.cumsum(2), sums.cumsum(2)
            whole, total = left[:, :, -1:], pushed[:, :, -1:]
            ok = (left >= least) & (whole - left >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = pushed ** 2 / left + (total - pushed) ** 2 / (whole - left) - total ** 2 / whole
            gain = np.where(ok, np.round(gain, 9), 0.0).reshape(nodes, -1)
            best = gain.argmax(1)  # of equal gains the first feature and the lowest bin
            level = {n: (int(features[best[n] // bins]), int(best[n] % bins)) for n in range(nodes) if gain[n, best[n]] > 0}
            self.splits.append(level)
            node = self._down(node, binned, level)
            if not level:
                break
        self.rows, self.leaves = rows, node

    @staticmethod
    def _down(node: np.ndarray, binned: np.ndarray, level: dict[int, tuple[int, int]]) -> np.ndarray:
        """Children of node n are 2n and 2n + 1; a node without a split goes on as 2n."""
        feature, cut = np.zeros(node.max(initial=0) + 1, "i8"), np.full(node.max(initial=0) + 1, np.iinfo("i8").max)
        for n, (f, b) in level.items():
            feature[n], cut[n] = f, b
        return 2 * node + (binned[np.arange(len(node)), feature[node]] > cut[node])

    def leaf(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), "i8")
        for level in self.splits:
            known = {n: s for n, s in level.items() if n <= node.max(initial=0)}
            node = self._down(node, binned, known)
        return node


def boost(x: np.ndarray, y: np.ndarray, due: np.ndarray, level: float, rounds: int, depth: int, rate: float, subsample: float,
          colsample: float, bins: int, least: int, seed: int) -> np.ndarray:
    """Forecasts for the rows ``due`` from trees learned on ``x`` and ``y``; leaves take the exact quantile of what is left to explain."""
    rng = np.random.default_rng(seed)
    cuts = _cuts(x, bins)
    binned = np.stack([np.minimum(np.searchsorted(c, v), len(c) - 1) for c, v in zip(cuts, x.T)], 1)
    asked = np.stack([np.minimum(np.searchsorted(c, v), len(c) - 1) for c, v in zip(cuts, due.T)], 1)
    start = lower_quantile(y, level)
    now, out = np.full(len(y), start), np.full(len(due), start)
    for _ in range(rounds):
        rows = np.sort(rng.permutation(len(y))[:max(1, int(subsample * len(y)))])
        features = np.sort(rng.permutation(x.shape[1])[:max(1, int(colsample * x.shape[1]))])
        left = y[rows] - now[rows]
        tree = Tree(binned[rows], np.where(left > 0, level, level - 1), features, bins + 1, depth, least)
        names, place = np.unique(tree.leaves, return_inverse=True)
        value = {int(n): rate * lower_quantile(left[place == i], level) for i, n in enumerate(names)}
        now = now + [value.get(n, 0.0) for n in tree.leaf(binned).tolist()]
        out = out + [value.get(n, 0.0) for n in tree.leaf(asked).tolist()]
    return out


def boosted_lags(panel: DataFrame, covariates: Sequence[str] = (), horizons: Sequence[int] = (1,), lags: int = 48,
                 levels: Sequence[float] = QUANTILE_LEVELS, retrain: int = 0, train_end: str | None = None, start_date: str | None = None,
                 rounds: int = 100, depth: int = 6, rate: float = 0.05, subsample: float = 0.9, colsample: float = 0.9, bins: int = 32,
                 least: int = 5, block_rows: int = 50_000, seed: int = 42) -> DataFrame:
    """Quantile forecasts of boosted trees on lags of log cases and covariates, pooled over the regions of a block.

    ``retrain`` is the number of periods between fits, the first at ``train_end`` (or the last known date, with a single fit then);
    0 fits once. A fit knows targets up to its time. It forecasts the dates whose origin, ``horizon`` before them, is at or
    after it and before the next fit's; a single fit also those before. Rows with a missing lag, blocks without training rows
    and regions without cases in training give no forecast. Rows of a region must follow each other without gaps.
    """
    freq = period_freq(panel) or "M"
    df = _timed(training_regions(panel, None, train_end), freq)
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate([LOG_CASES, *covariates])]
    df = df.select(GID_2, DATE, "_t", F.col(CASES).cast("double").alias(CASES), F.coalesce(FUTURE, F.lit(False)).alias("_future"), *values)
    due = F.col("_t") >= period_index(align_scalar(start_date, panel), freq) if start_date is not None else F.lit(True)
    df = df.withColumn("_due", due)
    bounds = df.agg(F.count("*").alias("n"), F.max(F.when(~F.col("_future"), F.col("_t"))).alias("known"), F.max("_t").alias("last"),
                    F.first(period_index(align_scalar(train_end, panel), freq) if train_end else F.lit(None).cast("int")).alias("end")).first()
    first = bounds["end"] if bounds["end"] is not None else bounds["known"]
    fits = [] if first is None else list(range(first, max(first, bounds["known"]) + 1, retrain)) if retrain else [first]
    blocks = max(1, -(-bounds["n"] // block_rows))
    cells = df.withColumn("_block", F.pmod(F.xxhash64(GID_2), F.lit(blocks)))
    made = [F.explode(F.array(*map(F.lit, values)).cast(kind)) for values, kind in (
        (horizons, "array<int>"), (fits, "array<int>"), (levels, "array<double>"))]
    for name, column in zip(("_h", "_f", "_q"), made):
        cells = cells.withColumn(name, column)
    # a fit's tasks read no further than its last forecast
    cells = cells.where((F.col("_t") <= F.col("_f") + F.col("_h") + (retrain or bounds["last"] or 0)))
    columns = [f"_v{i}" for i in range(len(values))]

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        h, fit, level = int(group["_h"].iloc[0]), int(group["_f"].iloc[0]), float(group["_q"].iloc[0])
        group = group.sort_values([GID_2, "_t"], kind="stable")
        x = np.vstack([lag_windows(own[columns].to_numpy("f8"), lags, h) for _, own in group.groupby(GID_2, sort=False)])
        whole, t, y = ~np.isnan(x).any(1), group["_t"].to_numpy(), group["_v0"].to_numpy("f8")
        train = whole & (t <= fit) & ~np.isnan(y) & ~group["_future"].to_numpy(bool)
        asked = whole & group["_due"].to_numpy(bool)
        if retrain:
            asked &= (t - h >= fit) & (t - h < fit + retrain)
        at = np.flatnonzero(asked) if train.any() else np.zeros(0, int)
        log = boost(x[train], y[train], x[at], level, rounds, depth, rate, subsample, colsample, bins, least, seed) if len(at) else np.zeros(0)
        rows = group.iloc[at]
        return pd.DataFrame({GID_2: rows[GID_2].to_numpy(), DATE: rows[DATE].to_numpy(), HORIZON: np.full(len(at), h, "i4"),
                             QUANTILE: np.full(len(at), level), PREDICTION: np.maximum(np.expm1(log), 0.0), CASES: rows[CASES].to_numpy()})

    out = spread(cells, "_block", "_h", "_f", "_q").groupBy("_block", "_h", "_f", "_q").applyInPandas(
        learn, f"{GID_2} string, {DATE} date, {HORIZON} int, {QUANTILE} double, {PREDICTION} double, {CASES} double")
    return with_period(out, freq)
