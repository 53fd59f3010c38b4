"""Boosted lags against a plain tree grower that tries every cut by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel.operators import access, boosting
from epipanel.schema import with_period


def _quantile(values, level):
    own = sorted(values)
    for v in own:
        if sum(x <= v for x in own) >= level * len(own) - 1e-9:
            return v


def _grow(x, push, rows, features, depth, least):
    """Nested ``(feature, value, low, high)`` or the rows of a leaf; cuts are ``x <= value`` for the values that occur."""
    best = (0.0, None)
    total = sum(push[r] for r in rows)
    if depth:
        for f in features:
            for value in sorted({x[r][f] for r in rows}):
                low = [r for r in rows if x[r][f] <= value]
                high = [r for r in rows if x[r][f] > value]
                if len(low) >= least and len(high) >= least:
                    a, b = sum(push[r] for r in low), sum(push[r] for r in high)
                    gain = round(a * a / len(low) + b * b / len(high) - total * total / len(rows), 9)
                    if gain > best[0]:
                        best = (gain, (f, value, low, high))
    if best[1] is None:
        return rows
    f, value, low, high = best[1]
    return f, value, _grow(x, push, low, features, depth - 1, least), _grow(x, push, high, features, depth - 1, least)


def _leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain(x, y, due, level, rounds, depth, rate, subsample, colsample, least, seed):
    rng = np.random.default_rng(seed)
    start = _quantile(y, level)
    now, out = [start] * len(y), [start] * len(due)
    for _ in range(rounds):
        rows = sorted(rng.permutation(len(y))[:max(1, int(subsample * len(y)))].tolist())
        features = sorted(rng.permutation(len(x[0]))[:max(1, int(colsample * len(x[0])))].tolist())
        push = {r: level if y[r] - now[r] > 0 else level - 1 for r in rows}
        left = {r: y[r] - now[r] for r in rows}
        tree = _grow(x, push, rows, features, depth, least)
        step = lambda row: rate * _quantile([left[r] for r in _leaf(tree, row)], level)
        more = [step(row) for row in x]
        out = [v + step(row) for v, row in zip(out, due)]
        now = [v + m for v, m in zip(now, more)]
    return out


@pytest.mark.parametrize("level", [0.1, 0.5, 0.9])
def test_boost_is_the_plain_grower(level):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (70, 5)).astype(float)
    y = x[:, 0] * (x[:, 1] > 4) + rng.standard_normal(70)
    due = rng.integers(0, 9, (30, 5)).astype(float)
    got = boosting.boost(x, y, due, level, 12, 3, 0.3, 0.9, 0.9, 16, 5, 7)
    assert np.allclose(got, plain(x.tolist(), y.tolist(), due.tolist(), level, 12, 3, 0.3, 0.9, 0.9, 5, 7), atol=1e-9)
    miss = y - boosting.boost(x, y, x, level, 80, 3, 0.3, 1.0, 1.0, 16, 5, 7)
    before = y - boosting.lower_quantile(y, level)
    loss = lambda e: np.where(e >= 0, level * e, (level - 1) * e).mean()
    assert loss(miss) < 0.6 * loss(before)


def _panel(spark, regions=3, months=40):
    rng = np.random.default_rng(3)
    ends = [dt.date(2020 + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(1) for m in range(months + 1)][:months]
    rows = [(f"g{i}", "G", d, int(20 + 10 * np.sin(m / 2) + 5 * i + rng.integers(0, 6)), float(np.cos(m / 2))) for i in range(regions) for m, d in enumerate(ends)]
    return with_period(spark.createDataFrame(rows, "GID_2 string, GID_1 string, Date date, Cases long, wet double"), "M"), rows, ends


@pytest.mark.parametrize("retrain", [0, 4])
def test_horizons_and_refits_by_loops(spark, retrain):
    panel, rows, ends = _panel(spark)
    out = boosting.boosted_lags(panel, ["wet"], horizons=(1, 3), lags=4, levels=(0.2, 0.5), retrain=retrain, train_end=str(ends[24]),
                                rounds=6, depth=2, rate=0.3, bins=200)
    got = {(r["GID_2"], r["Date"], r["horizon"], r["quantile"]): r["prediction"] for r in out.collect()}
    series = {g: [(np.log1p(c), w) for i, _, _, c, w in rows if i == g] for g in ("g0", "g1", "g2")}
    want = {}
    for h in (1, 3):
        for fit in range(24, 40, retrain) if retrain else [24]:
            made = {(g, k): [s[k - h - 3 + j][c] for c in (0, 1) for j in range(4)] for g, s in series.items() for k in range(h + 3, 40)}
            train = [key for key in sorted(made) if key[1] <= fit]
            due = [key for key in sorted(made) if not retrain or fit <= key[1] - h < fit + retrain]
            for q in (0.2, 0.5):
                found = plain([made[k] for k in train], [series[g][k][0] for g, k in train], [made[k] for k in due], q, 6, 2, 0.3, 0.9, 0.9, 5, 42) if due else []
                want |= {(g, ends[k], h, q): max(np.expm1(v), 0) for (g, k), v in zip(due, found)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_blocks_and_odd_panels(spark):
    panel, _, ends = _panel(spark, regions=6)
    options = dict(covariates=["wet"], lags=4, levels=(0.5,), rounds=3, train_end=str(ends[30]))
    whole, parts = boosting.boosted_lags(panel, **options), boosting.boosted_lags(panel, **options, block_rows=80)
    assert whole.count() == parts.count() == 6 * (40 - 4)
    assert boosting.boosted_lags(panel.limit(0), **options).count() == 0
    assert boosting.boosted_lags(panel, **{**options, "lags": 48}).count() == 0  # no window is whole
    gaps = panel.withColumn("wet", F.when(F.col("Date") != F.lit(str(ends[10])).cast("date"), F.col("wet")))
    assert boosting.boosted_lags(gaps, **options).count() == 6 * (40 - 4 - 4)
    assert access.pick(whole, quantile=0.5).count() == whole.count()
