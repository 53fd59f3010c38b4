"""Operators against plain loops and hand-worked values."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epipanel.functions import periods, scalars
from epipanel.operators import access, calibrate, ensemble, features, panel, quantiles, regions, samples, scoring
from epipanel.operators.residual_regression import RidgeBias, residual_regression
from epipanel.schema import QUANTILE_LEVELS, period_freq, with_period
from epipanel.sources import readers, tables
from epipanel.sources.registry import SourceRegistry
from epipanel.sources.store import StatStore


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(day("2025-01-15"), "A", "A_A", "active"), (day("2025-02-20"), "A", "A_A", "active"),
            (day("2025-01-10"), "A", "A_B", "active")]
    return spark.createDataFrame(rows, "Date date, GID_1 string, GID_2 string, Status string")


def test_tiny_counts(tiny):
    out = panel.cases_per_month(tiny)
    assert period_freq(out) == "M"
    got = {(r["GID_2"], r["Date"].isoformat()): r["Cases"] for r in out.collect()}
    assert got == {("A_A", "2025-01-31"): 1, ("A_A", "2025-02-28"): 1, ("A_B", "2025-01-31"): 1, ("A_B", "2025-02-28"): 0}


def test_week_starts(tiny):
    for freq, weekday in (("W-SAT", 6), ("W-SUN", 0), ("W", 0)):
        starts = tiny.select(periods.period_start(F.col("Date"), freq).alias("d")).collect()
        assert {r["d"].weekday() for r in starts} == {weekday}


def test_period_index_steps(spark):
    days = spark.sql("select explode(sequence(date'2019-12-20', date'2020-02-10')) as d")
    for freq in ("M", "D", "W-SUN", "W-SAT"):
        df = days.select(periods.period_index(F.col("d"), freq).alias("i"),
                         periods.period_index(periods.add_periods(F.col("d"), 3, freq), freq).alias("j"))
        assert df.where("j != i + 3").count() == 0


def test_mask_and_errors(tiny):
    assert access.mask(tiny, F.col("GID_2") == "none").count() == 0
    with pytest.raises(TypeError):
        access.mask(tiny, F.col("GID_2"))
    with pytest.raises(ValueError):
        access.filter_status(tiny.drop("Status"), ["active"])
    with pytest.raises(ValueError):
        panel.reindex(panel.cases_per_month(tiny).unionByName(panel.cases_per_month(tiny)))


def test_tables(spark, tiny, tmp_path):
    path = str(tmp_path / "cases")
    counted = panel.cases_per_month(tiny)
    tables.write_table(counted, path)
    back = tables.read_table(spark, path)
    assert period_freq(back) == "M" and back.count() == 4
    shuffled = back.select("Cases", "GID_1", "Date", "GID_2")
    tables.append_table(shuffled, path, regions=spark.createDataFrame([("A_A",), ("A_B",)], "GID_2 string"))
    assert tables.read_table(spark, path).count() == 8
    with pytest.raises(ValueError):
        tables.append_table(shuffled, path, regions=spark.createDataFrame([("A_A",)], "GID_2 string"))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "nothing"))
    assert tables.row_count(spark, "no_such_table") == 0


def test_csv_and_gridded(spark, tmp_path):
    (tmp_path / "list.csv").write_text("Date,GID_2,GID_1\n2020-01-31,GID_01,GID1\n2020-02-29,GID_02,GID1\n")
    assert readers.read_line_list(spark, str(tmp_path / "list.csv")).schema["Date"].dataType.simpleString() == "date"
    (tmp_path / "oni.txt").write_text(" SEAS  YR   TOTAL   ANOM\n  DJF 1950  24.72  -1.53\n  NDJ 1950  25.10  -0.80\n")
    got = {r["Date"]: r["TotalONI"] for r in readers.read_climate_index(spark, str(tmp_path / "oni.txt")).collect()}
    assert got == {day("1950-01-31"): 24.72, day("1950-12-31"): 25.10}
    cells = spark.createDataFrame([("prec", day("2020-01-31"), 0.5, 0.5, 1.0)], "metric string, Date date, x double, y double, value double")
    readers.write_gridded(cells, str(tmp_path / "grid"))
    assert readers.read_gridded(spark, str(tmp_path / "grid"), "prec").count() == 1


def test_store(spark, tmp_path):
    store = StatStore(spark, str(tmp_path / "stats"))
    row = lambda v: spark.createDataFrame([("tmin", day("2020-01-31"), "A", v)], "metric string, Date date, GID_2 string, mean double")
    store.add(row(1.0))
    store.add(row(2.0))
    wanted = row(0.0).select("metric", "Date", "GID_2")
    assert [r["mean"] for r in store.get(wanted).collect()] == [2.0]
    assert store.missing(wanted).count() == 0


def test_registry_errors(tiny):
    registry = SourceRegistry()
    for bad in ("noaa", "no.such.thing", "noaa.oni"):
        with pytest.raises(ValueError):
            registry.merge(tiny, [bad])


def test_accents_and_ratio(spark):
    pairs = [("São João", "saojoao"), ("ÑANDÚ", "nandu"), ("Łódź", "łodz")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(scalars.homogenise(F.col("a"))).collect()] == [b for _, b in pairs]
    cases = [("sao paulo", "paulo sao", 100.0), ("kitten", "sitting", 61.538462), ("abcd", "abxcd", 88.888889)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    for r in df.withColumn("got", scalars.token_sort_ratio(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6)


def _indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def test_fuzzy_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    letters = list("abcde ")
    known = sorted({"".join(rng.choice(letters, rng.integers(4, 25))).strip() or "a" for _ in range(60)})
    asked = set()
    for name in known:
        text = list(name)
        for _ in range(rng.integers(0, 4)):
            spot = rng.integers(0, len(text) + 1)
            if rng.random() < 0.5 and len(text) > 2:
                del text[min(spot, len(text) - 1)]
            else:
                text.insert(spot, rng.choice(letters))
        asked.add("".join(text))
    norm = lambda s: " ".join(sorted(s.split()))
    want = {}
    for q in asked:
        if not norm(q):
            continue
        best = max(((_indel(norm(q), norm(k)), -i, k) for i, k in enumerate(known) if norm(k)), default=None)
        if best and best[0] >= 90 - 1e-9:
            want[q] = best[2]
    left = spark.createDataFrame([(q,) for q in asked], "q string")
    right = spark.createDataFrame([(k, f"{i:04d}") for i, k in enumerate(known)], "k string, o string")
    got = {r["q"]: r["k"] for r in regions.fuzzy_match(left, right, "q", "k", "o").collect()}
    assert got == want


def test_exact_quantiles_hot_group(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.repeat(1.5, 3000), rng.normal(size=5000)])
    pdf = pd.DataFrame({"g": "hot", "v": values})
    pdf = pd.concat([pdf, pd.DataFrame({"g": "cold", "v": rng.normal(size=50)})])
    df = spark.createDataFrame(pdf)
    got = {(r["g"], r["quantile"]): r["value"] for r in quantiles.exact_quantiles(
        df, ["g"], "v", QUANTILE_LEVELS).collect()}
    for g, part in pdf.groupby("g"):
        for q in QUANTILE_LEVELS:
            assert got[(g, q)] == pytest.approx(np.quantile(part["v"], q), abs=1e-9)


def test_quantile_parts_do_not_follow_the_values(spark):
    values = [float(i) for i in range(20_000)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("g", F.lit("a"))
    parts = quantiles._ranged(df.groupBy("g", "v").agg(F.count("*").alias("c")), ["g"]).groupBy("bucket").count().collect()
    assert max(r["count"] for r in parts) < 3 * len(values) / len(parts)
    got = {r["quantile"]: r["value"] for r in quantiles.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.5: 10_000.0, 1.0: 1e12}


def test_dates_without_draws_count_for_the_trim(spark):
    months = [day(f"2020-{m:02d}-28") for m in range(1, 7)]
    rows = [("A", d, i, None if d == months[0] else float(i)) for d in months for i in range(5)]
    df = spark.createDataFrame(rows, "GID_2 string, Date date, sample int, prediction double").withColumn("Cases", F.lit(1))
    out = samples.samples_to_quantiles(df, [0.5])
    assert sorted(r["Date"] for r in out.collect()) == months[2:5]
    kept = {r["Date"]: r["prediction"] for r in samples.samples_to_quantiles(df, [0.5], trim=False).collect()}
    assert kept[months[0]] is None and kept[months[3]] == 2.0


def test_table_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(5), path)
    tables.write_table(tables.read_table(spark, path).withColumn("x", F.col("id") * 2), path)
    assert sorted(r["x"] for r in tables.read_table(spark, path).collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(Exception):
        tables.write_table(tables.read_table(spark, path).withColumn("y", F.raise_error(F.lit("no"))), path)
    assert tables.read_table(spark, path).count() == 5


@pytest.mark.parametrize("last", [None, 7])
def test_prefix_quantiles(spark, last):
    rng = np.random.default_rng(5)
    rows = [(1, int(t), int(i), float(v)) for t in range(12) for i, v in enumerate(rng.normal(size=rng.integers(0, 6)))]
    df = spark.createDataFrame(rows, "h int, t int, o int, v double")
    cuts = spark.createDataFrame([(1, t) for t in range(0, 14)], "h int, t int")
    if last is None:
        out = quantiles.prefix_quantiles(df, ["h"], "t", "v", cuts, block_rows=4)
    else:
        out = quantiles.recent_quantiles(df, ["h"], "t", "o", "v", cuts, last)
    got = {(r["t"], r["quantile"]): (r["value"], r["n"]) for r in out.collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {}
    for t in range(14):
        past = [r[3] for r in ordered if r[1] < t][-(last or 10**6):]
        for q in QUANTILE_LEVELS if past else ():
            want[(t, q)] = (np.quantile(past, q), len(past))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def _wis(y, q, p):
    q, p = np.array(q), np.maximum.accumulate(p)
    lo, hi = q[q < 0.5], q[q > 0.5]
    if 0.5 in q:
        m = p[list(q).index(0.5)]
    elif len(lo) and len(hi):
        m = np.interp(0.5, [lo.max(), hi.min()], [p[list(q).index(lo.max())], p[list(q).index(hi.min())]])
    else:
        return None
    total, weight = 0.5 * abs(y - m), 0.5
    for a in lo:
        match = [i for i, b in enumerate(q) if abs(b - (1 - a)) < 1e-9]
        if match:
            low, high = p[list(q).index(a)], p[match[0]]
            total += a * ((high - low) + (max(0, low - y) + max(0, y - high)) / a)
            weight += a
    return total / weight


def test_wis_by_loops(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for i in range(60):
        q = sorted(rng.choice([0.05, 0.1, 0.2, 0.25, 0.5, 0.75, 0.8, 0.9, 0.95], rng.integers(1, 9), replace=False))
        p, y = rng.gamma(2, 10, len(q)), float(rng.poisson(20))
        gid = f"g{i}"
        want[gid] = _wis(y, q, p)
        rows += [(gid, day("2020-01-31"), float(a), float(b), y) for a, b in zip(q, p)]
    df = spark.createDataFrame(rows, "GID_2 string, Date date, quantile double, prediction double, Cases double")
    got = {r["GID_2"]: r["WIS"] for r in scoring.wis(df).collect()}
    for gid, value in want.items():
        assert got[gid] == (pytest.approx(value) if value is not None else None)


def test_perfect_forecast(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "prediction double, Cases double")
    assert scoring.r2(df).first()["R2"] == 1.0 and scoring.rmse(df).first()["RMSE"] == 0.0


def test_ema_with_gaps(spark):
    values = [None, 2.0, None, 3.0, 5.0, None, None, 1.0]
    rows = [("A", day("2020-01-01") + dt.timedelta(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "GID_2 string, Date date, x double")
    spec = [{"name": "e", "column": "x", "groupby": ["GID_2"], "pipeline": [{"op": "ema", "span": 3}]}]
    got = [r["e"] for r in features.build_features(df, spec).orderBy("Date").collect()]
    want = pd.Series(values, dtype=float).ewm(span=3, adjust=False).mean()
    assert [math.nan if g is None else g for g in got] == pytest.approx(list(want), nan_ok=True)
    with pytest.raises(ValueError):
        features.build_features(df, [{"name": "e", "column": "x", "pipeline": [{"op": "nonsense"}]}])


def _forecast(spark, regions_=4, months=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(regions_):
        for t in range(months):
            d = (pd.Timestamp("2019-01-31") + pd.offsets.MonthEnd(t)).date()
            for q in (0.1, 0.5, 0.9):
                rows.append((f"g{g}", d, 1, q, float(rng.gamma(3, 5) + 20 * q), float(rng.poisson(15))))
    return with_period(spark.createDataFrame(
        rows, "GID_2 string, Date date, horizon int, quantile double, prediction double, Cases double"), "M")


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("window", [None, 5])
def test_calibration_is_causal(spark, window):
    df = _forecast(spark).where("quantile = 0.5")
    cut = F.col("Date") <= "2020-08-31"
    run = lambda d: calibrate.calibrate_forecast(d, window=window, min_history=4)
    assert _rows(run(df).where(cut)) == _rows(run(df.where(cut)))


def _simplex(n, parts):
    return [tuple(x / parts for x in (*head, parts - sum(head))) for head in itertools.product(range(parts + 1), repeat=n - 1) if sum(head) <= parts]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ensemble_weights_by_loops(spark, n):
    """The found loss against every point of a fine grid, for every history; the gap bounds what is left."""
    base = _forecast(spark, 3, 10)
    p = F.col("prediction")
    makers = {"a": p, "b": p * 0.5, "c": F.lit(14.0), "d": F.col("Cases") * 0.5 + F.col("quantile") * 12}
    parts = {m: base.withColumn("prediction", makers[m].cast("double")) for m in list(makers)[:n]}
    weights = ensemble.train_weights(ensemble.stack_models(parts), list(parts), step=0.01)
    got = {}
    for r in weights.collect():
        own = got.setdefault(r["Date"], {"w": {}})
        own["w"][r["model"]] = r["weight"]
        own |= {"loss": r["loss"], "gap": r["gap"]}
    pdfs = [x.toPandas().sort_values(["GID_2", "Date", "quantile"]) for x in parts.values()]
    for d, own in got.items():
        past = [x[x["Date"] <= d] for x in pdfs]
        preds, y, q = np.stack([x["prediction"] for x in past]), past[0]["Cases"].to_numpy(), past[0]["quantile"].to_numpy()

        def loss(w):
            miss = y - np.array(w) @ preds
            return np.where(miss >= 0, q * miss, (q - 1) * miss).mean()

        w = [own["w"][m] for m in parts]
        least = min(map(loss, _simplex(n, 20)))
        assert sum(w) == pytest.approx(1) and min(w) >= 0
        assert own["loss"] == pytest.approx(loss(w), abs=1e-8)
        assert loss(w) - least <= own["gap"] + 1e-7  # the bound holds
        assert loss(w) <= least * 1.05 + 1e-9  # and the search is good, also where few rows make a rough loss


def test_ensemble_weights_where_models_lack_rows(spark):
    base = _forecast(spark, 3, 10)
    late = base.where("Date > '2020-04-30'")
    weights = ensemble.train_weights(ensemble.stack_models({"a": base, "b": late}), ["a", "b"])
    assert {r["weight"] for r in weights.collect()} == {0.5} and weights.where("loss is not null").count() == 0
    assert ensemble.train_weights(ensemble.stack_models({"a": base, "b": late}).limit(0), ["a", "b"]).count() == 0


def test_tiny_violations(spark):
    rows = [("g", day("2020-01-31"), q, p) for q, p in ((0.1, 1.0), (0.2, 0.95), (0.3, 0.5), (0.4, 0.45))]
    df = spark.createDataFrame(rows, "GID_2 string, Date date, quantile double, prediction double")
    got = [r["prediction"] for r in calibrate.lift_tiny_violations(df, 0.1).orderBy("quantile").collect()]
    assert got == [1.0, 1.0, 0.5, 0.5]


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(7)
    df = _forecast(spark, 8, 12, seed=4).where("quantile = 0.5")
    x = rng.normal(size=(8, 3))
    emb = spark.createDataFrame([(f"g{i}", [float(v) for v in row]) for i, row in enumerate(x)], "GID_2 string, embedding array<double>")
    got = {r["GID_2"]: r["bias"] for r in RidgeBias(emb, alpha=2.0).fit(df).biases().collect()}
    pdf = df.toPandas()
    rows = x[[int(g[1:]) for g in pdf["GID_2"]]]
    y = (pdf["Cases"] - pdf["prediction"]).to_numpy()
    c, m = rows - rows.mean(0), rows.mean(0)
    beta = np.linalg.solve(c.T @ c + 2.0 * np.eye(3), c.T @ (y - y.mean()))
    for i in range(8):
        assert got[f"g{i}"] == pytest.approx(y.mean() + (x[i] - m) @ beta, abs=1e-8)
    with pytest.raises(ValueError):
        RidgeBias(emb.where("GID_2 != 'g1'")).fit(df)


@pytest.mark.parametrize("method", ["ridge", "pinball"])
def test_residual_regression_by_loops(spark, monkeypatch, method):
    """Blocks of two regions, added two at a time, give what one fit per date over all rows gives."""
    from epipanel.operators import residual_regression as module

    monkeypatch.setattr(module, "FAN_IN", 2)
    df = _forecast(spark, 9, 10, seed=3).where("not (GID_2 = 'g3' and month(Date) < 6)")
    x = np.random.default_rng(5).normal(size=(9, 2)).astype("f4")
    emb = spark.createDataFrame([(f"g{i}", [float(v) for v in row]) for i, row in enumerate(x)], "GID_2 string, embedding array<float>")
    got = {(r["GID_2"], r["Date"], r["quantile"]): r["prediction"]
           for r in residual_regression(df, emb, method=method, window=4, rounds=3, regions_per_task=2).collect()}
    rows = df.where("horizon = 1").toPandas() if "horizon" in df.columns else df.toPandas()
    assert len(got) == len(rows)
    rows["t"] = [d.year * 12 + d.month for d in rows["Date"]]
    wide = np.column_stack([np.ones(9), x.astype(float)])
    rows["e"] = np.log1p(rows["Cases"].astype(float)) - np.log1p(rows["prediction"])
    for (t, q), some in rows.groupby(["t", "quantile"]):
        seen = rows[(rows["quantile"] == q) & (rows["t"] <= t - 1) & (rows["t"] > t - 5) & rows["e"].notna()]
        own = wide[[int(g[1:]) for g in seen["GID_2"]]]
        w, beta = np.ones(len(seen)), np.zeros(3)
        for _ in range((1 if method == "ridge" else 3) if len(seen) else 0):
            beta = np.linalg.solve((own.T * w) @ own + np.diag([1e-9, 1.0, 1.0]), own.T @ (w * seen["e"]))
            left = seen["e"].to_numpy() - own @ beta
            w = np.where(left >= 0, q, 1 - q) / np.maximum(np.abs(left), 1e-4)
        for r in some.itertuples():
            want = max(np.expm1(np.log1p(r.prediction) + wide[int(r.GID_2[1:])] @ beta), 0)
            assert got[r.GID_2, r.Date, q] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_residual_regression_per_repetition(spark):
    df = _forecast(spark, 4, 8).where("quantile = 0.5")
    emb = spark.createDataFrame([(f"g{i}", r, [float(i * (r + 1) % 3)]) for i in range(4) for r in range(3)],
                                "GID_2 string, rep int, embedding array<float>")
    whole = residual_regression(df, emb, method="ridge")
    for r in range(3):
        one = residual_regression(df, emb.where(f"rep = {r}").drop("rep"), method="ridge")
        assert _rows(whole.where(f"rep = {r}").drop("rep")) == _rows(one)


def test_residual_regression_causal_and_unchanged_start(spark):
    df = _forecast(spark, 6, 14)
    emb = spark.createDataFrame([(f"g{i}", [float(i), float(i * i % 5)]) for i in range(6)], "GID_2 string, embedding array<double>")
    cut = F.col("Date") <= "2019-09-30"
    run = lambda d: residual_regression(d, emb, window=6)
    whole = run(df)
    assert _rows(whole.where(cut)) == _rows(run(df.where(cut)))
    first = whole.where("Date = date'2019-01-31'").join(df.withColumnRenamed("prediction", "p0"), ["GID_2", "Date", "horizon", "quantile"])
    assert first.where("abs(prediction - p0) > 1e-9").count() == 0
    assert whole.count() == df.count()


def test_pipeline(spark, small, tmp_path):
    from epipanel.operators.covariates import standard_sources
    from epipanel.plans import pipeline, views

    cases = views.counted_list(spark, small).drop("Status")
    regions_ = cases.groupBy("GID_2").agg(F.min("GID_1").alias("GID_1")).withColumns(
        {"GID_0": F.lit("TST"), "NAME_1": F.col("GID_1"), "NAME_2": F.col("GID_2"), "HASC_2": F.lit("x")})
    extra = spark.createDataFrame([("TST.99.1_1", "TST.99_1", "TST", "n", "m", "x")], "GID_2 string, GID_1 string, GID_0 string, NAME_1 string, NAME_2 string, HASC_2 string")
    path = str(tmp_path)
    table = pipeline.build_cases(cases, regions_.unionByName(extra), path)
    before, after = cases.agg(F.sum("Cases")).first()[0], table.agg(F.sum("Cases")).first()[0]
    assert before == after and table.where("future").select("Date").distinct().count() == 12
    registry = standard_sources(views.climate_stats(spark, small), views.drought(spark, small),
                                views.ocean_index(spark, small), views.population_stats(spark, small))
    ready = pipeline.build_model_input(table, registry, path, "1999-12-31")
    forecasts = pipeline.run_forecasts(ready, path, {"baseline": {}, "sarima": {"level": 0}})
    scores = pipeline.combine_and_score(forecasts, path, step=0.25)
    assert {r["model"] for r in scores.select("model").distinct().collect()} == {"baseline", "sarima", "ensemble"}


def test_pooled_backtest_by_loops(spark):
    from epipanel.operators import harness

    rng = np.random.default_rng(2)
    ends = [dt.date(2020 + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(1) for m in range(31)][1:]
    rows = [(f"g{i}", f"s{i % 2}", d, None if m >= 27 or (i, m) == (1, 9) else int(rng.integers(0, 30)), float(rng.normal()), m >= 27)
            for i in range(4) for m, d in enumerate(ends)]
    panel_ = with_period(spark.createDataFrame(rows, "GID_2 string, GID_1 string, Date date, Cases long, wet double, future boolean"), "M")
    mean = harness.Forecaster(  # the mean of the group's log cases plus that of the last covariate
        learn=lambda s, ends_: np.array([[np.nansum(s.upto(e).y), np.sum(~np.isnan(s.upto(e).y))] for e in ends_]),
        fit=lambda v: np.array([v[0] / v[1]]), predict=lambda state, s, h: state[0] + s.x[-1, 0] * 0.01 * h)
    for level, group in ((0, lambda i: "all"), (1, lambda i: i % 2), (2, lambda i: i)):
        for retrain in (0, 1, 5):
            out = harness.backtest_groups(panel_, mean, horizons=(1, 4), level=level, covariates=["wet"], retrain=retrain, min_train=6)
            got = {(r["GID_2"], r["Date"], r["horizon"]): r["prediction"] for r in out.collect()}
            value = {(int(r[0][1:]), ends.index(r[2])): (r[3], r[4]) for r in rows}
            want = {}
            for i in range(4):
                for k in range(30):
                    for h in (1, 4):
                        origin = min(k - h, 26)
                        f = 26 if not retrain else 5 + (origin - 5) // retrain * retrain
                        if origin < 5:
                            continue
                        own = [np.log1p(c) for (j, m), (c, _) in value.items() if group(j) == group(i) and m <= f and c is not None]
                        want[f"g{i}", ends[k], h] = max(np.expm1(np.mean(own) + value[i, origin][1] * 0.01 * (k - origin)), 0)
            if not retrain:  # a single fit at the end serves origins from the first possible fit on
                assert got.keys() <= want.keys()
            else:
                assert got.keys() == want.keys()
            assert got and all(got[k] == pytest.approx(want[k]) for k in got)
    assert harness.backtest_groups(panel_.limit(0), mean).count() == 0
