"""The monthly steps after the forecasts, against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel.plans import pipeline
from epipanel.schema import QUANTILE_LEVELS, with_period

ROWS = "GID_2 string, Date date, horizon int, quantile double, prediction double, Cases double"
ENDS = [dt.date(2020 + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(1) for m in range(1, 9)]


def _forecast(spark, regions=4, horizons=(1, 2), factor=1.0):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(regions):
        for h in horizons:
            for d in ENDS:
                centre, truth = rng.uniform(5, 40), float(rng.integers(0, 60))
                rows += [(f"TST.1.{i}_1", d, h, q, factor * centre * (0.5 + q), truth) for q in QUANTILE_LEVELS]
    return rows, with_period(spark.createDataFrame(rows, ROWS), "M")


def test_scores_by_loops(spark, tmp_path):
    (a, left), (b, right) = _forecast(spark), _forecast(spark, factor=1.7)
    scores = pipeline.score_forecasts({"m": left, "m_adjusted": right}, str(tmp_path))
    assert tuple(scores) == pipeline.SCORE_TABLES
    performance = {(r["model"], r["horizon"]): r for r in scores["model_performance"].collect()}
    medians = {}
    for model, rows in (("m", a), ("m_adjusted", b)):
        for h in (1, 2):
            own = [(g, np.log1p(p), np.log1p(y)) for g, _, hh, q, p, y in rows if hh == h and q == 0.5]
            rmse = [np.expm1(np.sqrt(np.mean([(p - y) ** 2 for gg, p, y in own if gg == g]))) for g in sorted({g for g, _, _ in own})]
            got = performance[model, h]
            assert got["RMSE_mean"] == pytest.approx(np.mean(rmse)) and got["RMSE_std"] == pytest.approx(np.std(rmse, ddof=1))
            assert [got[f"RMSE_q{k}"] for k in (25, 50, 75)] == pytest.approx(np.quantile(rmse, [0.25, 0.5, 0.75]))
            assert got["RMSE_flat"] == pytest.approx(np.expm1(np.sqrt(np.mean([(p - y) ** 2 for _, p, y in own]))))
            medians[model, h] = np.median(rmse)
    change = {r["horizon"]: r["delta_RMSE_q50"] for r in pipeline.change_by_horizon(scores["model_performance"], "m", str(tmp_path)).collect()}
    assert change == {h: pytest.approx(medians["m_adjusted", h] - medians["m", h]) for h in (1, 2)}
    each = pipeline.wis_change(scores["wis"], "m", str(tmp_path)).collect()
    assert len(each) == 4 * 2 * len(ENDS) and {r["GID_1"] for r in each} == {"TST.1_1"}
    truth = {(g, d, h): y for g, d, h, _, _, y in a}
    assert all(r["Cases"] == pytest.approx(truth[r["GID_2"], r["Date"], r["horizon"]]) for r in each)
    assert all(r["delta_WIS"] == pytest.approx(r["WIS_adjusted"] - r["WIS_base"]) for r in each)


def test_adjusted_and_suspects(spark, tmp_path):
    _, forecast = _forecast(spark)
    # region 3 has no vector, region 0 has the same one twice
    vectors = spark.createDataFrame([("TST.1.0_1", [1.0, 0.0]), ("TST.1.0_1", [1.0, 0.0]), ("TST.1.1_1", [0.0, 1.0]), ("TST.1.2_1", [0.5, 0.5])],
                                    "GID_2 string, embedding array<float>")
    fixed = pipeline.adjust_forecasts({"m": forecast}, vectors, str(tmp_path), window=3, horizons=(1, 2), method="ridge")
    assert list(fixed) == ["m_adjusted"]
    rows = fixed["m_adjusted"]
    assert rows.count() == 3 * 2 * len(ENDS) * len(QUANTILE_LEVELS) and rows.where("GID_2 = 'TST.1.3_1'").count() == 0
    first = rows.where(F.col("Date") == ENDS[0]).join(forecast.withColumnRenamed("prediction", "p0"), ["GID_2", "Date", "horizon", "quantile"])
    assert first.where("abs(prediction - p0) > 1e-9").count() == 0  # nothing known yet

    odd = forecast.withColumn("prediction", F.when((F.col("GID_2") == "TST.1.1_1") & (F.col("horizon") == 2), F.lit(None)).when(
        F.col("GID_2") == "TST.1.2_1", F.lit(2e8)).otherwise(F.col("prediction")))
    model_input = spark.createDataFrame([("a", ENDS[0], 1.0, 2.0), ("a", ENDS[1], 1.0, 3.0), ("b", ENDS[0], None, 1.0), ("b", ENDS[1], None, 2.0),
                                         ("a", ENDS[7], 9.0, 9.0)], "GID_2 string, Date date, still double, moving double")
    found = pipeline.report_suspects({"m": forecast, "odd": odd}, model_input, str(tmp_path), str(ENDS[6]))
    assert {tuple(r) for r in found["outliers"].select("model", "horizon", "GID_2", "has_null", "too_large").collect()} == {
        ("odd", 2, "TST.1.1_1", True, False), ("odd", 1, "TST.1.2_1", False, True), ("odd", 2, "TST.1.2_1", False, True)}
    assert {tuple(r) for r in found["static_covariates"].collect()} == {("a", "still"), ("b", "still")}


def test_scores_of_nothing(spark, tmp_path):
    _, forecast = _forecast(spark, regions=1)
    scores = pipeline.score_forecasts({"m": forecast.limit(0)}, str(tmp_path))
    assert all(t.count() == 0 for t in scores.values())
    assert pipeline.change_by_horizon(scores["model_performance"], "m", str(tmp_path)).count() == 0
