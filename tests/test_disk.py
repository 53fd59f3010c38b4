"""What is written on the way of a job, and left behind."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel.operators import ensemble, residual_regression
from epipanel.schema import CASES, DATE, GID_2
from epipanel.sources.stage import DROP_SHUFFLES, stage, staged


def test_a_stored_table_leaves_no_shuffle(spark):
    def kept():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before, setting = kept(), spark.conf.get(DROP_SHUFFLES)
    out = stage(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("g")).count())
    assert kept() <= before and spark.conf.get(DROP_SHUFFLES) == setting
    assert {r["count"] for r in out.collect()} == {100}


def models_of(spark, change=lambda rows: rows):
    rows = [(h, f"r{g}", dt.date(2020, m, 28), q, float(g * m + h + 10 * q), float((g * 5 + m * m) % 13))
            for h in (1, 2) for g in range(6) for m in range(1, 8) for q in (0.1, 0.5, 0.9)]
    of = lambda rows: spark.createDataFrame(rows, f"horizon int, {GID_2} string, {DATE} date, quantile double, prediction double, {CASES} double")
    return {"a": of(change(rows)), "b": of([(*r[:4], 12 - r[4], r[5]) for r in rows])}, rows


def test_an_ensemble_stores_a_forecast_once_for_all_models(spark, monkeypatch):
    forecasts, rows = models_of(spark)
    sizes = []

    def watched(df):
        out = stage(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ensemble, "stage", watched)
    out, weights = ensemble.create_ensemble(forecasts, step=0.1)
    assert max(sizes) == len(rows) == out.count()
    w = {(r["horizon"], r[DATE], r["model"]): r["weight"] for r in weights.collect()}
    days = sorted({r[2] for r in rows})
    got = {(r["horizon"], r[GID_2], r[DATE], r["quantile"]): (r["prediction"], r["ensemble_ready"]) for r in out.collect()}
    for h, g, day, q, p, _ in rows:
        at = days.index(day)
        want = w[h, days[at - 1], "a"] * p + w[h, days[at - 1], "b"] * (12 - p) if at else p
        assert got[h, g, day, q] == (pytest.approx(want), at > 0)


def test_an_ensemble_of_odd_rows(spark):
    # a row twice, a prediction and a truth missing, a level and a date that one model lacks, a null region
    def change(rows):
        rows = [r for r in rows if r[3] != 0.9 and r[2].month != 4]
        return rows + [rows[8], (1, None, dt.date(2020, 5, 28), 0.5, 3.0, 4.0), (*rows[3][:3], 0.1, None, 2.0), (1, "r9", dt.date(2020, 2, 28), 0.5, 7.0, None)]

    forecasts, rows = models_of(spark, change)
    out, _ = ensemble.create_ensemble(forecasts, step=0.5)
    got = {(r["horizon"], r[GID_2], r[DATE], r["quantile"]): r for r in out.collect()}
    assert {k[3] for k in got} == {0.1, 0.5} and 4 not in {k[2].month for k in got}
    assert len(got) == out.count() == 2 * 6 * 6 * 2 + 2
    alone = got[1, "r9", dt.date(2020, 2, 28), 0.5]
    assert alone[CASES] is None and alone["ensemble_ready"]
    # apply_weights by itself: duplicates add up, rows follow the first model
    weights = spark.createDataFrame([(1, dt.date(2020, 1, 28), m, x) for m, x in (("a", 0.25), ("b", 0.75))], f"horizon int, {DATE} date, model string, weight double")
    rows = [(1, "x", dt.date(2020, 1, 28), 0.5, "a", 1.0, 5.0), (1, "x", dt.date(2020, 2, 28), 0.5, "a", 2.0, 5.0), (1, "x", dt.date(2020, 2, 28), 0.5, "a", 4.0, 6.0),
            (1, "x", dt.date(2020, 2, 28), 0.5, "b", 8.0, 9.0), (1, "x", dt.date(2020, 2, 28), 0.9, "b", 8.0, 9.0), (1, "y", dt.date(2020, 2, 28), 0.5, "a", None, None)]
    df = spark.createDataFrame(rows, f"horizon int, {GID_2} string, {DATE} date, quantile double, model string, prediction double, {CASES} double")
    found = {(r[GID_2], r[DATE].month): (r["prediction"], r[CASES], r["ensemble_ready"]) for r in ensemble.apply_weights(df, weights, ["a", "b"]).collect()}
    assert found == {("x", 1): (1.0, 5.0, False), ("x", 2): (7.5, 6.0, True), ("y", 2): (0.0, None, True)}


def test_a_table_for_a_while_is_deleted(spark):
    with staged(spark.range(5)) as table:
        files = table.inputFiles()
        assert table.count() == 5 and files
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(*files)


def test_noise_is_the_hash_of_its_place(spark):
    names = ["a", "TST.7.1234_1", "\u00e9t\u00e9", None, "x" * 60, "y" * 45]
    vectors = spark.createDataFrame([(g, [0.0] * (3 + i % 2)) for i, g in enumerate(names)] + [("none", None), ("empty", [])], f"{GID_2} string, embedding array<float>")
    out = residual_regression.noise_embeddings(vectors, reps=12, seed=42)
    plan = out._jdf.queryExecution().toString()
    assert "md5" not in plan  # 16 bytes of text per number once went through five string functions
    got = {(r[GID_2], r["rep"]): r["embedding"] for r in out.collect()}
    assert got["none", 3] is None and got["empty", 3] == []
    for i, g in enumerate(names):
        for rep in range(12):
            def uniform(k, salt):
                text = ":".join(str(x) for x in (g, rep, k, 42, salt) if x is not None)
                return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52

            want = [math.sqrt(-2 * math.log(uniform(k, 1))) * math.cos(2 * math.pi * uniform(k, 2)) for k in range(3 + i % 2)]
            assert got[g, rep] == pytest.approx(want, rel=1e-12, abs=1e-14)


def regression_rows(spark, regions=9, months=14):
    rows = [(h, f"r{g}", dt.date(2020 + m // 12, m % 12 + 1, 28), q, float((g * 3 + m * 5 + 7 * q) % 11) if (g + m) % 9 else None, float((g * g + m * 3) % 13))
            for h in (1, 3) for g in range(regions) for m in range(months) for q in (0.2, 0.5)]
    df = spark.createDataFrame(rows, f"horizon int, {GID_2} string, {DATE} date, quantile double, prediction double, {CASES} double")
    vectors = [(f"r{g}", k, [float(g % 4), float((k + 1) * g % 5)]) for g in range(regions) for k in range(2)]
    return rows, df, vectors, spark.createDataFrame(vectors, f"{GID_2} string, rep int, embedding array<float>")


@pytest.mark.parametrize("method,window", [("ridge", 4), ("ridge", None), ("pinball", 4), ("pinball", None)])
def test_regression_by_loops_stores_no_more_than_its_forecast(spark, monkeypatch, method, window):
    rows, df, vectors, features = regression_rows(spark)
    columns = []

    def watched(table):
        columns.append(table.columns)
        return stage(table)

    monkeypatch.setattr(residual_regression, "stage", watched)
    out = residual_regression.residual_regression(df, features, method=method, window=window, horizons=(1, 3), rounds=3, regions_per_task=4)
    assert {"_base", "_e"}.isdisjoint(columns[0]) and not any("e" in c for c in columns[1:])
    got = {(r["horizon"], r["quantile"], r["rep"], r[GID_2], r[DATE]): r["prediction"] for r in out.collect()}
    assert len(got) == 2 * len(rows)
    days = sorted({r[2] for r in rows})
    errors = {(h, q, g, days.index(d)): math.log1p(y) - math.log1p(p) for h, g, d, q, p, y in rows if p is not None}
    for rep in (0, 1):
        x = {g: np.array([1.0, *v]) for g, k, v in vectors if k == rep}
        for h in (1, 3):
            for q in (0.2, 0.5):
                for t, day in enumerate(days):
                    past = [(x[g], e) for (a, b, g, u), e in errors.items() if (a, b) == (h, q) and u <= t - h and (window is None or u > t - h - window)]
                    beta = np.zeros(3)
                    for turn in range(3 if method == "pinball" else 1):
                        square, side = np.diag([1e-9, 1.0, 1.0]), np.zeros(3)
                        for v, e in past:
                            left = e - v @ beta
                            w = 1.0 if turn == 0 else (q if left >= 0 else 1 - q) / max(abs(left), 1e-4)
                            square, side = square + w * np.outer(v, v), side + w * e * v
                        beta = np.linalg.solve(square, side)
                    for r in (r for r in rows if r[0] == h and r[3] == q and r[2] == day):
                        p = got[h, q, rep, r[1], day]
                        want = None if r[4] is None else max(math.expm1(math.log1p(r[4]) + (x[r[1]] @ beta if past else 0.0)), 0.0)
                        assert p == (want if want is None else pytest.approx(want, rel=1e-5, abs=1e-6))


@pytest.mark.parametrize("most", [62, 2])
def test_fixed_weights_shuffle_a_forecast_not_its_levels(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(ensemble, "LEVELS", most)
    day = dt.date(2020, 1, 31)
    rows = [("a", "x", day, 0.1, 2.0, 5.0), ("b", "x", day, 0.1, 6.0, 7.0), ("a", "x", day, 0.5, 3.0, 5.0), ("a", "x", day, 0.5, 5.0, 5.0),
            ("b", "x", day, 0.9, None, None), ("a", None, day, None, 1.0, 2.0), ("c", "x", day, 0.7, 1.0, 1.0)]
    df = spark.createDataFrame(rows, f"model string, {GID_2} string, {DATE} date, quantile double, prediction double, {CASES} double")
    out = ensemble.combine_fixed(df, {"a": 1.0, "b": 3.0})
    capsys.readouterr()
    out.explain()
    by_level = "quantile" in capsys.readouterr().out.split("hashpartitioning(")[1].split(")")[0]
    assert by_level == (most == 2)
    got = {(r[GID_2], r["quantile"]): (r["prediction"], r[CASES]) for r in out.collect()}
    assert got == {("x", 0.1): (5.0, 7.0), ("x", 0.5): (2.0, 5.0), ("x", 0.9): (None, None), (None, None): (0.25, 2.0)}
    assert ensemble.combine_fixed(df.limit(0), {"a": 1.0}).count() == 0


def test_regression_refuses_missing_and_uneven_vectors(spark):
    _, df, vectors, _ = regression_rows(spark, 3, 6)
    of = lambda rows: spark.createDataFrame(rows, f"{GID_2} string, embedding array<float>")
    for odd in (None, [1.0]):
        with pytest.raises(Exception, match="of one length"):
            residual_regression.residual_regression(df, of([("r0", odd), ("r1", [1.0, 2.0]), ("r2", [2.0, 2.0])]), method="ridge").collect()
