"""Steps whose memory, spill or disk once grew faster than their tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from epipanel import schema
from epipanel.operators import baseline, covariates, residual_regression, scoring
from epipanel.schema import DATE, GID_2, QUANTILE_LEVELS


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_embeddings_are_the_hashed_side(spark, capsys):
    # a forecast looks small until its levels multiply it
    forecast = spark.range(3).select(F.col("id").cast("string").alias(GID_2)).withColumn("quantile", F.explode(F.sequence(F.lit(1), F.lit(5))))
    vectors = spark.range(2).select(F.col("id").cast("string").alias(GID_2), F.array(F.lit(1.0)).alias("embedding"))
    out = covariates.attach_embeddings(forecast, vectors, check=False)
    plan = plan_of(out, capsys)
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "Broadcast" not in plan
    assert out.count() == 10


def panel_of(spark, regions, periods=20):
    rows = [(f"r{g}", dt.date(2020 + i // 12, i % 12 + 1, 28), float((g * 7 + i * i) % 11)) for g in range(regions) for i in range(periods)]
    return spark.createDataFrame(rows, f"{GID_2} string, {DATE} date, Cases double")


def test_forecast_has_parts_by_its_rows(spark, monkeypatch):
    panel = panel_of(spark, 40)
    whole = baseline.baseline(panel, [1, 3])
    monkeypatch.setattr(schema, "PART_ROWS", 400)
    small = baseline.baseline(panel, [1, 3])
    # 40 regions, 20 dates, 2 horizons, 13 levels
    assert small.rdd.getNumPartitions() == 52 > whole.rdd.getNumPartitions()
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))


def test_noise_has_parts_by_its_numbers(spark, monkeypatch):
    vectors = spark.createDataFrame([(f"r{g}", [0.0] * 8) for g in range(10)], f"{GID_2} string, embedding array<float>")
    whole = residual_regression.noise_embeddings(vectors, reps=5)
    monkeypatch.setattr(schema, "PART_ROWS", 20)
    many = residual_regression.noise_embeddings(vectors, reps=5)
    assert many.rdd.getNumPartitions() == 20
    assert sorted(map(str, many.collect())) == sorted(map(str, whole.collect()))


def test_regression_has_parts_by_what_comes_out(spark, monkeypatch):
    forecast = panel_of(spark, 10).withColumn("prediction", F.col("Cases") + F.col("Cases") % 3)
    vectors = spark.createDataFrame([(f"r{g}", k, [float(g % 4), float(k + g) / 5]) for g in range(10) for k in range(6)],
                                    f"{GID_2} string, rep int, embedding array<float>")
    monkeypatch.setattr(schema, "PART_ROWS", 100)
    out = residual_regression.residual_regression(forecast, vectors, method="ridge", window=6)
    # 200 rows by 6 repetitions; a repetition alone gives the same
    assert out.rdd.getNumPartitions() == 12
    one = residual_regression.residual_regression(forecast, vectors.where("rep = 2").drop("rep"), method="ridge", window=6)
    ordered = lambda df: [r["prediction"] for r in df.orderBy(GID_2, DATE).collect()]
    assert ordered(out.where("rep = 2")) == pytest.approx(ordered(one))


def test_scores_run_once_for_their_distribution(spark, capsys):
    scores = spark.range(9).select(F.lit("m").alias("model"), F.lit(1).alias("horizon"), F.col("id").cast("double").alias("R2"),
                                   F.when(F.col("id") > 4, F.col("id") * 2.0).alias("WIS"))
    out = scoring.score_distribution(scores, ["R2", "WIS"])
    plan = plan_of(out, capsys)
    assert "Range" not in plan.replace("RangePartitioning", "") and "parquet" in plan
    got = {r["metric"]: (r["mean"], r["q25"], r["q50"], r["q75"]) for r in out.collect()}
    assert got == {"R2": (4.0, 2.0, 4.0, 6.0), "WIS": (13.0, 11.5, 13.0, 14.5)}


def test_loss_of_a_level_repeats_none_before_it(spark, capsys):
    def place(i, g):
        return {2: 0.1 + 1e-9, 4: 0.1 + 0.2}.get(i, QUANTILE_LEVELS[i]) if g % 2 else QUANTILE_LEVELS[i]

    # predictions that fall in places, levels that need rounding, a level too many, a level missing, a null
    rows = [(f"r{g}", dt.date(2020, 1, 31), place(i, g), None if (g, i) == (5, 3) else float((g * 5 + i * 7) % 9 + i), float(g % 8))
            for g in range(7) for i in range(13) if (g, i) != (6, 12)]
    rows += [("r1", dt.date(2020, 1, 31), 0.45, 99.0, 1.0), ("r1", dt.date(2020, 1, 31), None, 99.0, 1.0)]
    df = spark.createDataFrame(rows, f"{GID_2} string, {DATE} date, quantile double, prediction double, Cases double")
    out = scoring.wis_at_levels(df, QUANTILE_LEVELS)
    plan = plan_of(out, capsys)
    assert max(len(x.split(",")) for x in re.findall(r"greatest\(([^()]*)\)", plan)) == 2
    want = {}
    for g in range(7):
        held = {round(q, 6): p for n, _, q, p, _ in rows if n == f"r{g}" and q is not None}
        if g > 4:
            want[f"r{g}"] = None
            continue
        loss, top = 0.0, 0.0
        for q in QUANTILE_LEVELS:
            top = max(top, held[q])
            miss = g % 8 - top
            loss += q * miss if miss >= 0 else (q - 1) * miss
        want[f"r{g}"] = loss / (0.5 + sum(q for q in QUANTILE_LEVELS if q < 0.5))
    got = {r[GID_2]: r["WIS"] for r in out.collect()}
    assert got == {k: v if v is None else pytest.approx(v, rel=1e-12) for k, v in want.items()}
