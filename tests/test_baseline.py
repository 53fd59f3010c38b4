"""Baseline forecasts against exact hand-worked numbers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel.operators.baseline import baseline, sample_baseline, seasonal_average
from epipanel.schema import QUANTILE_LEVELS, with_period


def month_end(year, month):
    nxt = dt.date(year + month // 12, month % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


@pytest.fixture(scope="module")
def line(spark):
    rows = [(month_end(2023, m), "A", "X", m * 10.0, m > 5) for m in range(1, 9)]
    df = spark.createDataFrame(rows, "Date date, GID_1 string, GID_2 string, Cases double, future boolean")
    return with_period(df, "M")


def by_month(df):
    out = {}
    for r in df.where("horizon = 1").collect():
        out.setdefault(r["Date"].month, {})[round(r["quantile"], 2)] = r["prediction"]
    return out


def test_draws_asymmetric(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", -1.0)], "g string, d double")
    rows = sample_baseline(df, ["g"], "d", 10.0, 5, horizon=3, symmetrize=False).collect()
    for step, shift in ((1, 0.0), (2, 0.5), (3, 1.0)):
        got = sorted(r["prediction"] for r in rows if r["step"] == step)
        assert got == pytest.approx([x + shift for x in (9, 9.75, 10.5, 11.25, 12)])


def test_draws_symmetric(spark):
    df = spark.createDataFrame([("a", 2.0)], "g string, d double")
    rows = sample_baseline(df, ["g"], "d", 10.0, 5, horizon=3).collect()
    for step in (1, 2, 3):
        assert sorted(r["prediction"] for r in rows if r["step"] == step) == pytest.approx([8, 9, 10, 11, 12])


def test_straight_line_symmetric(line):
    got = by_month(baseline(line, 1, True, num_samples=3))
    for m in (1, 2, 3):
        assert got[m] == {0.5: None}
    ends = np.array([0, 0.5, 1.0])
    for m, low, mid, high in ((4, 20, 30, 40), (5, 30, 40, 50), (6, 40, 50, 60), (7, 40, 50, 60), (8, 40, 50, 60)):
        want = {round(q, 2): np.interp(q, ends, [low, mid, high]) for q in QUANTILE_LEVELS}
        assert got[m] == pytest.approx(want)


def test_straight_line_asymmetric(line):
    got = by_month(baseline(line, 1, False, num_samples=3))
    for m, want in ((4, 40), (5, 50), (6, 60), (7, 70), (8, 80)):
        assert list(got[m].values()) == pytest.approx([want] * len(QUANTILE_LEVELS))


def plain_baseline(cases, future, horizon, symmetrize, n):
    """The same forecast by direct loops over one series."""
    cases = np.asarray(cases, float)
    d = np.diff(cases, prepend=np.nan)
    d = np.where(np.isnan(d), 0, d)
    out = {}
    for h in range(1, horizon + 1):
        for k in range(2 + h, len(cases)):
            pool = d[1:k - h]
            pool = np.concatenate([pool, -pool]) if symmetrize else pool
            draws = np.quantile(pool, np.linspace(0, 1, n))
            level = cases[k - h] if not future[k - h] else out.get((h, k - h, 0.5), np.nan)
            steps = 1 if symmetrize else h
            for _ in range(steps):
                raw = level + draws
                cur = raw - (np.median(raw) - level) if symmetrize else raw
                level = level if symmetrize else np.median(cur)
            for q, v in zip(QUANTILE_LEVELS, np.quantile(np.clip(cur, 0, None), QUANTILE_LEVELS)):
                out[(h, k, q)] = v
    return out


@pytest.mark.parametrize("symmetrize", [True, False])
def test_against_loops(spark, symmetrize):
    rng = np.random.default_rng(1)
    cases = [float(x) for x in rng.poisson(3, 30)] + [None] * 7
    future = [False] * 30 + [True] * 7
    rows = [(month_end(2019 + i // 12, i % 12 + 1), "X", c, f) for i, (c, f) in enumerate(zip(cases, future))]
    df = spark.createDataFrame(rows, "Date date, GID_2 string, Cases double, future boolean")
    want = plain_baseline([np.nan if c is None else c for c in cases], future, 3, symmetrize, 100)
    index = {r[0]: i for i, r in enumerate(sorted(rows))}
    got = {(r["horizon"], index[r["Date"]], r["quantile"]): r["prediction"]
           for r in baseline(df, 3, symmetrize, num_samples=100).where("prediction is not null").collect()}
    want = {k: v for k, v in want.items() if not np.isnan(v)}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_causal(spark, line):
    whole = baseline(line, 2).where(F.col("Date") <= "2023-05-31")
    part = baseline(line.where(F.col("Date") <= "2023-05-31"), 2)
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))


def test_seasonal_average(spark):
    rows = [(month_end(y, m), "X", float(100 * (y - 2010) + m), False) for y in range(2010, 2018) for m in range(1, 13)]
    df = with_period(spark.createDataFrame(rows, "Date date, GID_2 string, Cases double, future boolean"), "M")
    got = {r["Date"]: r["prediction"] for r in seasonal_average(df, start_date="2015-01-01").collect()}
    assert len(got) == 36
    assert got[month_end(2016, 3)] == pytest.approx(np.mean([100 * i + 3 for i in range(1, 6)]))
