"""Covariates and features over the sample tables."""

from pyspark.sql import functions as F

from epipanel.operators import checks, climate_features, covariates, features
from epipanel.plans import views
from epipanel.plans.catalog import cte, query
from epipanel.schema import CASES, DATE, GID_1, GID_2
from epipanel.sources import store
from epipanel.sources.registry import SourceRegistry, new_columns


def rounded(df, *names, digits=6):
    """Keep region, date and the named columns, rounded."""
    return df.select(GID_2, DATE, *[F.round(F.col(c), digits).alias(c) for c in names])


def sql_rounded(*names, digits=6):
    return ", ".join(f'round({n}, {digits}) AS {n}' for n in names)


_COVARS = ("tmin", "tmax", "prec", "SPI6", "TotalONI", "AnomONI", "pop_count", "DIR")


@query("covariate_panel", f'SELECT GID_2, "Date", {sql_rounded(*_COVARS)} FROM covariate_panel', "covariate_panel")
def _(spark, d):
    return rounded(views.covariate_panel(spark, d), *_COVARS)


@query("new_covariate_columns", """
  SELECT p.GID_2, p."Date", p.Cases, round(d.mean, 6) AS mean FROM supplier_panel p
  LEFT JOIN drought d ON d.GID_2 = p.GID_2 AND d."Date" = p."Date" """, "supplier_panel", "drought")
def _(spark, d):
    other = views.drought(spark, d).withColumn(CASES, F.lit(-1))
    out = covariates.merge_new_columns(views.supplier_panel(spark, d), other)
    return out.select(GID_2, DATE, CASES, F.round("mean", 6).alias("mean"))


@query("covariate_dispatch", f"""
  SELECT p.GID_2, p."Date", {sql_rounded("c.tmin", "c.prec", "o.AnomONI").replace("AS c.", "AS ").replace("AS o.", "AS ")}
  FROM supplier_panel p LEFT JOIN climate c ON c.GID_2 = p.GID_2 AND c."Date" = p."Date"
  LEFT JOIN ocean_index o ON o."Date" = p."Date" """, "supplier_panel", "climate", "ocean_index")
def _(spark, d):
    registry = SourceRegistry()
    registry.register("worldclim", lambda p, fields: covariates.join_climate(p, views.climate_stats(spark, d), fields))
    registry.register("noaa", lambda p, fields: covariates.join_climate_index(p, views.ocean_index(spark, d)))
    panel = views.supplier_panel(spark, d)
    out = registry.merge(panel, ["worldclim.tmin", "worldclim.prec", "noaa.oni"])
    assert new_columns(panel, out) == ["tmin", "prec", "TotalONI", "AnomONI"]
    return rounded(out, "tmin", "prec", "AnomONI")


@query("observed_else_forecast_source", """
  SELECT GID_2, "Date", metric, round(mean, 6) AS mean, source FROM (
    SELECT *, row_number() OVER (PARTITION BY GID_2, "Date", metric ORDER BY rank) AS rn FROM (
      SELECT GID_2, "Date", metric, mean, 'observed' AS source, 0 AS rank FROM climate_stats WHERE year("Date") <= 1999
      UNION ALL SELECT GID_2, "Date", metric, mean * 1.1, 'forecast', 1 FROM climate_stats)) WHERE rn = 1""",
       "climate_stats")
def _(spark, d):
    stats = views.climate_stats(spark, d)
    best = covariates.best_source({
        "observed": covariates.observed_until(stats, 1999),
        "forecast": stats.withColumn("mean", F.col("mean") * 1.1)})
    return best.select(GID_2, DATE, "metric", F.round("mean", 6).alias("mean"), "source")


@query("population_by_year", """
  SELECT p.GID_2, p."Date",
    CASE WHEN year(p."Date") <= 2020 THEN n.pop_count ELSE n.pop_estimate_unconstrained END AS pop_count,
    n.pop_estimate_constrained, n.pop_estimate_unconstrained
  FROM (SELECT * REPLACE (last_day("Date" + INTERVAL 264 MONTH) AS "Date") FROM supplier_panel) p
  LEFT JOIN population n ON n.GID_2 = p.GID_2 AND n.year + 22 = year(p."Date")""", "supplier_panel", "population")
def _(spark, d):
    from epipanel.operators.baseline import shift_dates

    later = shift_dates(views.supplier_panel(spark, d), 22 * 12)
    yearly = views.population_stats(spark, d).withColumn("year", F.col("year") + 22)
    out = covariates.join_population(later, yearly, ["*"])
    return out.select(GID_2, DATE, "pop_count", "pop_estimate_constrained", "pop_estimate_unconstrained")


@query("incidence_of_forecasts", """
  SELECT f.GID_2, f."Date", f.quantile, f.horizon, round(100000.0 * f.Cases / nullif(c.pop_count, 0), 4) AS Cases,
         round(100000.0 * f.prediction / nullif(c.pop_count, 0), 4) AS prediction
  FROM baseline_forecast f LEFT JOIN covariate_panel c ON c.GID_2 = f.GID_2 AND c."Date" = f."Date"
  """, "baseline_forecast", "covariate_panel")
def _(spark, d):
    pop = views.covariate_panel(spark, d).select(GID_2, DATE, "pop_count")
    out = covariates.to_incidence(views.baseline_forecast(spark, d), pop)
    return out.select(GID_2, DATE, "quantile", "horizon", F.round(CASES, 4).alias(CASES),
                      F.round("prediction", 4).alias("prediction"))


@query("covariate_null_counts", """
  SELECT 'tmin' AS "column", count(*) FILTER (WHERE tmin IS NULL) AS nulls FROM covariate_panel
  UNION ALL SELECT 'pop_count', count(*) FILTER (WHERE pop_count IS NULL) FROM covariate_panel""", "covariate_panel")
def _(spark, d):
    return checks.null_counts(views.covariate_panel(spark, d), ["tmin", "pop_count"])


@query("static_covariates", """
  SELECT GID_2, covariate FROM (
    SELECT GID_2, 'pop_count' AS covariate, pop_count AS v, "Date" FROM covariate_panel
    UNION ALL SELECT GID_2, 'tmin', tmin, "Date" FROM covariate_panel)
  WHERE "Date" < DATE '1996-01-01' GROUP BY 1, 2 HAVING count(DISTINCT v) <= 1""", "covariate_panel")
def _(spark, d):
    return checks.static_covariates(views.covariate_panel(spark, d), ["pop_count", "tmin"], "1996-01-01")


cte("stored_stats", """
  SELECT metric, "Date", GID_2, mean, 0 AS batch FROM climate_stats
  UNION ALL SELECT metric, "Date", GID_2, mean + 1, 1 FROM climate_stats WHERE metric = 'tmin'""", "climate_stats")


def _stored(spark, d):
    stats = views.climate_stats(spark, d)
    first = stats.withColumn("batch", F.lit(0))
    second = stats.where("metric = 'tmin'").withColumns({"mean": F.col("mean") + 1, "batch": F.lit(1)})
    return first.unionByName(second)


@query("stored_statistics_lookup", """
  SELECT metric, "Date", GID_2, round(arg_max(mean, batch), 6) AS mean FROM stored_stats
  WHERE (GID_2, "Date") IN (SELECT GID_2, "Date" FROM supplier_panel WHERE Cases > 200)
  GROUP BY 1, 2, 3""", "stored_stats", "supplier_panel")
def _(spark, d):
    wanted = views.supplier_panel(spark, d).where(F.col(CASES) > 200)
    keys = wanted.withColumn("metric", F.explode(F.array(F.lit("tmin"), F.lit("tmax"), F.lit("prec"))))
    found = store.lookup(_stored(spark, d), keys)
    return found.select("metric", DATE, GID_2, F.round("mean", 6).alias("mean"))


@query("stored_statistics_misses", """
  SELECT DISTINCT GID_2, "Date" FROM supplier_panel p
  WHERE NOT EXISTS (SELECT 1 FROM stored_stats s WHERE s.GID_2 = p.GID_2 AND s."Date" = p."Date")""",
       "stored_stats", "supplier_panel")
def _(spark, d):
    return store.misses(_stored(spark, d), views.supplier_panel(spark, d), [GID_2, DATE])


@query("stored_statistics_record", """
  SELECT metric, "Date", GID_2, round(arg_max(mean, batch), 6) AS mean FROM stored_stats
  WHERE metric = 'tmin' AND "Date" = DATE '1998-03-31' AND GID_2 = 'TST.5.5_1' GROUP BY 1, 2, 3""", "stored_stats")
def _(spark, d):
    return store.get_record(_stored(spark, d), "tmin", "1998-03-31", "TST.5.5_1").select(
        "metric", DATE, GID_2, F.round("mean", 6).alias("mean"))


_REGION = '(PARTITION BY GID_2 ORDER BY "Date")'


def _frame(first, last):
    return f'(PARTITION BY GID_2 ORDER BY "Date" ROWS BETWEEN {first} PRECEDING AND {last})'


def _roll(column, window, agg="avg", back=0):
    last = "CURRENT ROW" if back == 0 else f"{back} PRECEDING"
    f = _frame(window - 1 + back, last)
    return f"CASE WHEN count({column}) OVER {f} >= {window} THEN {agg}({column}) OVER {f} END"


cte("log_panel", "SELECT *, ln(1 + Cases) AS Log_Cases, row_number() OVER (PARTITION BY GID_2 ORDER BY \"Date\") AS rn FROM covariate_panel",
    "covariate_panel")

_LAGS = [(c, k) for c in ("tmax", "tmin", "prec") for k in (0, 1, 2)]


@query("full_features_lags", f"""
  SELECT GID_2, "Date", {", ".join(f"round(lag({c}, {k}) OVER {_REGION}, 6) AS {c}_lag_{k}" for c, k in _LAGS)},
    round(SPI6, 6) AS spi6_lag_0, round(TotalONI, 6) AS oni_lag_0, pop_count AS pop_lag_0,
    round({_roll("TotalONI", 6)}, 6) AS oni_6m_lag_0, round({_roll("TotalONI", 12)}, 6) AS oni_12m_lag_0,
    round(sin(2 * pi() * month("Date") / 12), 6) AS sin_month, round(cos(2 * pi() * month("Date") / 12), 6) AS cos_month
  FROM log_panel""", "log_panel")
def _(spark, d):
    out = features.full_features(views.covariate_panel(spark, d))
    return rounded(out, *[f"{c}_lag_{k}" for c, k in _LAGS], "spi6_lag_0", "oni_lag_0", "pop_lag_0", "oni_6m_lag_0",
                   "oni_12m_lag_0", "sin_month", "cos_month")


@query("full_features_cases", f"""
  SELECT GID_2, "Date", round(log_cases_lag_1, 6) AS log_cases_lag_1,
    round({_roll("Log_Cases", 12, back=1)}, 6) AS log_cases_12m_ma,
    round({_roll("Log_Cases", 24, back=1)}, 6) AS log_cases_24m_ma,
    round({_roll("Log_Cases", 48, back=1)}, 6) AS log_cases_48m_ma,
    round({_roll("Log_Cases", 12, "sum", 1)}, 6) AS log_cases_12m_cum,
    round(CASE WHEN log_cases_lag_1 IS NOT NULL THEN sum(Log_Cases) OVER
      (PARTITION BY GID_2 ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 6) AS log_cases_cum,
    round(slope, 6) AS log_cases_slope,
    round({_roll("slope", 6)}, 6) AS log_cases_slope_6m, round({_roll("slope", 12)}, 6) AS log_cases_slope_12m,
    round({_roll("rn", 12, back=1).replace("avg(rn)", "regr_slope(Log_Cases, rn)")}, 6) AS log_cases_12m_trend
  FROM (SELECT *, log_cases_lag_1 - lag(log_cases_lag_1) OVER {_REGION} AS slope
        FROM (SELECT *, lag(Log_Cases) OVER {_REGION} AS log_cases_lag_1 FROM log_panel))""", "log_panel")
def _(spark, d):
    out = features.full_features(views.covariate_panel(spark, d))
    return rounded(out, "log_cases_lag_1", "log_cases_12m_ma", "log_cases_24m_ma", "log_cases_48m_ma",
                   "log_cases_12m_cum", "log_cases_cum", "log_cases_slope", "log_cases_slope_6m",
                   "log_cases_slope_12m", "log_cases_12m_trend")


def _early(column, window, agg="avg", back=0):
    """A rolling column from its first value on, 0 before."""
    last = "CURRENT ROW" if back == 0 else f"{back} PRECEDING"
    return f"round(coalesce({agg}({column}) OVER {_frame(window - 1 + back, last)}, 0), 6)"


@query("full_features_filled", f"""
  SELECT GID_2, "Date", {", ".join(f"round(coalesce(lag({c}, {k}) OVER {_REGION}, 0), 6) AS {c}_lag_{k}" for c, k in _LAGS)},
    round(coalesce(SPI6, 0), 6) AS spi6_lag_0, round(coalesce(TotalONI, 0), 6) AS oni_lag_0,
    {_early("TotalONI", 6)} AS oni_6m_lag_0, {_early("TotalONI", 12)} AS oni_12m_lag_0, coalesce(pop_count, 0) AS pop_lag_0,
    round(coalesce(log_cases_lag_1, 0), 6) AS log_cases_lag_1, {_early("Log_Cases", 12, back=1)} AS log_cases_12m_ma,
    {_early("Log_Cases", 24, back=1)} AS log_cases_24m_ma, {_early("Log_Cases", 48, back=1)} AS log_cases_48m_ma,
    {_early("Log_Cases", 12, "sum", 1)} AS log_cases_12m_cum, round(coalesce(slope, 0), 6) AS log_cases_slope,
    {_early("slope", 6)} AS log_cases_slope_6m, {_early("slope", 12)} AS log_cases_slope_12m
  FROM (SELECT *, log_cases_lag_1 - lag(log_cases_lag_1) OVER {_REGION} AS slope
        FROM (SELECT *, lag(Log_Cases) OVER {_REGION} AS log_cases_lag_1 FROM log_panel))""", "log_panel")
def _(spark, d):
    out = features.full_features(views.covariate_panel(spark, d), min_periods=1, fill=0.0)
    return rounded(out, *[f"{c}_lag_{k}" for c, k in _LAGS], "spi6_lag_0", "oni_lag_0", "oni_6m_lag_0", "oni_12m_lag_0", "log_cases_lag_1",
                   "log_cases_12m_ma", "log_cases_24m_ma", "log_cases_48m_ma", "log_cases_12m_cum", "log_cases_slope",
                   "log_cases_slope_6m", "log_cases_slope_12m", "pop_lag_0")


@query("default_covariates", f"""
  SELECT GID_2, "Date", CAST(month("Date") AS INTEGER) AS "MONTH", round(Log_Cases, 6) AS Log_Cases,
    round(lag(Log_Cases) OVER {_REGION}, 6) AS lag_1_log_cases, round(tmin_roll_2, 6) AS tmin_roll_2,
    round(lag(tmin_roll_2) OVER {_REGION}, 6) AS lag_1_tmin_roll_2, round(prec_roll_2, 6) AS prec_roll_2,
    round(lag(prec_roll_2) OVER {_REGION}, 6) AS lag_1_prec_roll_2
  FROM (SELECT *, {_roll("tmin", 2)} AS tmin_roll_2, {_roll("prec", 2)} AS prec_roll_2 FROM log_panel)""", "log_panel")
def _(spark, d):
    out, _case, _names = features.default_covariates(views.covariate_panel(spark, d))
    return rounded(out, "Log_Cases", "lag_1_log_cases", "tmin_roll_2", "lag_1_tmin_roll_2", "prec_roll_2",
                   "lag_1_prec_roll_2", "MONTH").withColumn("MONTH", F.col("MONTH").cast("int"))


@query("feature_pipeline_ops", f"""
  SELECT GID_2, "Date", round(tmin / nullif(lag(tmin) OVER {_REGION}, 0) - 1, 6) AS tmin_change,
    round(CASE WHEN (COALESCE(Cases, 0) - lag(Cases, 2) OVER {_REGION}) IS NULL THEN NULL
      ELSE least(greatest(CAST(Cases - lag(Cases, 2) OVER {_REGION} AS DOUBLE), -50), 50) END, 6) AS cases_diff,
    round(COALESCE({_roll("prec", 3, "max")}, -1), 6) AS prec_peak,
    round(sqrt(CAST(Cases AS DOUBLE)), 6) AS root_cases
  FROM covariate_panel""", "covariate_panel")
def _(spark, d):
    region = [GID_2]
    specs = [
        {"name": "tmin_change", "column": "tmin", "groupby": region, "pipeline": [{"op": "pct_change"}]},
        {"name": "cases_diff", "column": CASES, "groupby": region,
         "pipeline": [{"op": "diff", "periods": 2}, {"op": "clip", "lower": -50, "upper": 50},
                      {"op": "lambda", "func": lambda c: c.cast("double")}]},
        {"name": "prec_peak", "column": "prec", "groupby": region,
         "pipeline": [{"op": "rolling", "window": 3, "agg": "max"}, {"op": "fillna", "value": -1}]},
        {"name": "root_cases", "column": CASES, "pipeline": [{"op": "lambda", "func": F.sqrt}]},
    ]
    return rounded(features.build_features(views.covariate_panel(spark, d), specs),
                   "tmin_change", "cases_diff", "prec_peak", "root_cases")


@query("exponential_average", """
  , ema AS (
    SELECT GID_2, "Date", rn, CAST(Log_Cases AS DOUBLE) AS m FROM log_panel WHERE rn = 1
    UNION ALL
    SELECT p.GID_2, p."Date", p.rn, 0.6 * e.m + 0.4 * p.Log_Cases
    FROM ema e JOIN log_panel p ON p.GID_2 = e.GID_2 AND p.rn = e.rn + 1)
  SELECT GID_2, "Date", round(m, 6) AS ema_4 FROM ema""", "log_panel", recursive=True)
def _(spark, d):
    logged = views.supplier_panel(spark, d).withColumn("Log_Cases", F.log1p(CASES))
    specs = [{"name": "ema_4", "column": "Log_Cases", "groupby": [GID_2], "pipeline": [{"op": "ema", "span": 4}]}]
    return rounded(features.build_features(logged, specs), "ema_4")


cte("seasonal_filled", """
  SELECT GID_2, "Date", COALESCE(tmin, avg(tmin) OVER (PARTITION BY GID_2, month("Date"))) AS tmin,
         COALESCE(SPI6, avg(SPI6) OVER (PARTITION BY GID_2, month("Date"))) AS SPI6 FROM covariate_panel""",
    "covariate_panel")
# a value and the holes behind it (before it) have the same count of values up to them (from them on)
cte("filled_along", f"""
  SELECT GID_2, "Date", {", ".join(f'COALESCE(CASE WHEN {c}_up > 0 THEN max({c}) OVER (PARTITION BY GID_2, {c}_up) END, max({c}) OVER (PARTITION BY GID_2, {c}_down)) AS {c}'
                                  for c in ("tmin", "SPI6"))}
  FROM (SELECT *, {", ".join(f'count({c}) OVER (PARTITION BY GID_2 ORDER BY "Date") AS {c}_up, count({c}) OVER (PARTITION BY GID_2 ORDER BY "Date" DESC) AS {c}_down'
                            for c in ("tmin", "SPI6"))} FROM seasonal_filled)""", "seasonal_filled")


@query("seasonal_fill", f'SELECT GID_2, "Date", {sql_rounded("tmin", "SPI6")} FROM seasonal_filled', "seasonal_filled")
def _(spark, d):
    return rounded(features.seasonal_fill(views.covariate_panel(spark, d), ["tmin", "SPI6"]), "tmin", "SPI6")


cte("filled_norms", """
  SELECT 1 AS one, avg(abs(tmin)) AS tmin_norm, avg(abs(SPI6)) AS spi6_norm FROM filled_along WHERE "Date" < DATE '1999-01-01'""",
    "filled_along")


@query("sanitised_covariates", """
  SELECT GID_2, "Date", round(tmin / tmin_norm, 6) AS tmin, round(SPI6 / spi6_norm, 6) AS SPI6
  FROM (SELECT *, 1 AS one FROM filled_along) JOIN filled_norms USING (one)""", "filled_along", "filled_norms")
def _(spark, d):
    out = features.sanitise_covariates(views.covariate_panel(spark, d), ["tmin", "SPI6"], "1999-01-01", check=False)
    return rounded(out, "tmin", "SPI6")


@query("undone_differences", """
  SELECT GID_2, "Date", CAST(Cases AS BIGINT) AS Cases FROM supplier_panel""", "supplier_panel")
def _(spark, d):
    w = features.by_region()
    steps = views.supplier_panel(spark, d).withColumn(
        CASES, F.coalesce(features.diff(F.col(CASES), w), F.col(CASES)))
    return features.undo_difference(steps, CASES).select(GID_2, DATE, CASES)


cte("yoy_base", f"""
  SELECT *, DIR - COALESCE(lag(DIR, 12) OVER {_REGION}, 0) AS d0, lead(DIR, 12) OVER {_REGION} AS ahead FROM covariate_panel""",
    "covariate_panel")


@query("year_on_year_features", f"""
  SELECT GID_2, "Date", round(h, 6) AS HISTORICAL_DIR, round(x, 6) AS DIFF_WITH_HISTORICAL_DIR,
         round(COALESCE(lag(x) OVER {_REGION}, 0), 6) AS MODIFIED_DIFF_WITH_HISTORICAL_DIR_LAG
  FROM (SELECT GID_2, "Date", COALESCE(lag(DIR, 12) OVER {_REGION}, 0) AS h, COALESCE(d0, DIR - ahead) AS x FROM yoy_base)""",
       "yoy_base")
def _(spark, d):
    return rounded(climate_features.year_on_year(views.covariate_panel(spark, d)), "HISTORICAL_DIR",
                   "DIFF_WITH_HISTORICAL_DIR", "MODIFIED_DIFF_WITH_HISTORICAL_DIR_LAG")


cte("rsi_moves", f"""
  SELECT GID_2, "Date", row_number() OVER {_REGION} AS rn,
    greatest(x - lag(x) OVER {_REGION}, 0) AS up, greatest(lag(x) OVER {_REGION} - x, 0) AS down
  FROM (SELECT GID_2, "Date", CAST(Cases AS DOUBLE) AS x FROM supplier_panel)""", "supplier_panel")


@query("rsi_features", f"""
  , smooth AS (
    SELECT GID_2, 4 AS rn, avg(up) AS up, avg(down) AS down FROM rsi_moves WHERE rn BETWEEN 2 AND 4 GROUP BY 1
    UNION ALL
    SELECT m.GID_2, m.rn, (s.up * 2 + m.up) / 3, (s.down * 2 + m.down) / 3
    FROM smooth s JOIN rsi_moves m ON m.GID_2 = s.GID_2 AND m.rn = s.rn + 1),
  r AS (SELECT m.GID_2, m."Date", COALESCE(100 * s.up / nullif(s.up + s.down, 0), 0) AS v
        FROM rsi_moves m LEFT JOIN smooth s ON s.GID_2 = m.GID_2 AND s.rn = m.rn)
  SELECT GID_2, "Date", round(v, 5) AS RSI_DIR, round(COALESCE(lag(v) OVER {_REGION}, 0), 5) AS RSI_DIR_LAG,
         round(COALESCE(lag(v) OVER {_REGION}, 0) ** 2, 3) AS SQ_RSI_DIR_LAG FROM r""", "rsi_moves", recursive=True)
def _(spark, d):
    panel = views.supplier_panel(spark, d).withColumn("DIR", F.col(CASES).cast("double"))
    out = climate_features.rsi_features(panel)
    return out.select(GID_2, DATE, F.round("RSI_DIR", 5).alias("RSI_DIR"),
                      F.round("RSI_DIR_LAG", 5).alias("RSI_DIR_LAG"), F.round("SQ_RSI_DIR_LAG", 3).alias("SQ_RSI_DIR_LAG"))


_CLIMATE_LAGS = [f"{c}_roll_2_lag{k}" for c in ("tmin", "prec") for k in range(1, 5)]


@query("climate_lags", f"""
  SELECT GID_2, "Date", {", ".join(f"round(lag({c}_roll_2, {k}) OVER {_REGION}, 6) AS {c}_roll_2_lag{k}" for c in ("tmin", "prec") for k in range(1, 5))},
    {", ".join(f"round(lag(SPI6, {k}) OVER {_REGION}, 6) AS SPI6_lag{k}" for k in (1, 2))},
    {", ".join(f"round(lag(TotalONI, {k}) OVER {_REGION}, 6) AS TotalONI_lag{k}" for k in range(1, 5))}
  FROM (SELECT *, {_roll("tmin", 2)} AS tmin_roll_2, {_roll("prec", 2)} AS prec_roll_2 FROM covariate_panel)""",
       "covariate_panel")
def _(spark, d):
    return rounded(climate_features.climate_lags(views.covariate_panel(spark, d)), *_CLIMATE_LAGS,
                   "SPI6_lag1", "SPI6_lag2", *[f"TotalONI_lag{k}" for k in range(1, 5)])


def _cube(x, at):
    return f"pow(greatest({x} - {at}, 0), 3)"


@query("spline_basis", f"""
  SELECT GID_2, "Date", round(x, 6) AS oni_1,
    round(CASE WHEN x IS NOT NULL THEN ({_cube("x", "lo")} - {_cube("x", "hi")}) / (hi - lo) - ({_cube("x", "mid")} - {_cube("x", "hi")}) / (hi - mid) END, 5) AS oni_2
  FROM (SELECT GID_2, "Date", lag(TotalONI) OVER {_REGION} AS x FROM covariate_panel),
       (SELECT min(x) AS lo, quantile_cont(x, 0.5) AS mid, max(x) AS hi
        FROM (SELECT lag(TotalONI) OVER {_REGION} AS x FROM covariate_panel))""", "covariate_panel")
def _(spark, d):
    from epipanel.functions.splines import add_natural_basis, fit_knots

    w = features.by_region()
    lagged = views.covariate_panel(spark, d).withColumn("x", features.lag(F.col("TotalONI"), w, 1))
    out = add_natural_basis(lagged, fit_knots(lagged, {"x": 2}), {"x": "oni"})
    return out.select(GID_2, DATE, F.round("oni_1", 6).alias("oni_1"), F.round("oni_2", 5).alias("oni_2"))


_BASES = {**climate_features.basis_prefixes()}
_DIFF = "MODIFIED_DIFF_WITH_HISTORICAL_DIR_LAG"
_SPLINES = {**{c: (2, p) for c, p in _BASES.items()}, _DIFF: (4, _BASES.get(_DIFF, _DIFF))}
_LAGGED = [*_CLIMATE_LAGS, "SPI6_lag1", "SPI6_lag2", *[f"TotalONI_lag{k}" for k in range(1, 5)]]


def _sql_basis(column, df, prefix):
    """Natural basis of a column whose knots are ``k_<column>[1..]``."""
    at = [f"k_{column}[{i + 1}]" for i in range(df + 1)]
    part = lambda i: f"({_cube(column, at[i])} - {_cube(column, at[df])}) / nullif({at[df]} - {at[i]}, 0)"
    out = [f"round({column}, 5) AS {prefix}_1"]
    return out + [f"round(CASE WHEN {column} IS NOT NULL THEN COALESCE({part(i)} - {part(df - 1)}, 0) END, 4) AS {prefix}_{i + 2}" for i in range(df - 1)]


_TABLE = ["TIME", "GID_2_codes", "MONTH", "YEAR", "POP_OFFSET", "SEASON", "DIR", "HISTORICAL_DIR", "DIFF_WITH_HISTORICAL_DIR", _DIFF,
          "RSI_DIR", "RSI_DIR_LAG", "SQ_RSI_DIR_LAG", *_LAGGED]


@query("climate_feature_table", f"""
  , moves AS MATERIALIZED (
    SELECT GID_2, "Date", row_number() OVER {_REGION} AS rn, greatest(DIR - lag(DIR) OVER {_REGION}, 0) AS up, greatest(lag(DIR) OVER {_REGION} - DIR, 0) AS down
    FROM covariate_panel),
  smooth AS (
    SELECT GID_2, 4 AS rn, avg(up) AS up, avg(down) AS down FROM moves WHERE rn BETWEEN 2 AND 4 GROUP BY 1
    UNION ALL
    SELECT m.GID_2, m.rn, (s.up * 2 + m.up) / 3, (s.down * 2 + m.down) / 3 FROM smooth s JOIN moves m ON m.GID_2 = s.GID_2 AND m.rn = s.rn + 1),
  rsi AS (SELECT m.GID_2, m."Date", COALESCE(100 * s.up / nullif(s.up + s.down, 0), 0) AS v FROM moves m LEFT JOIN smooth s ON s.GID_2 = m.GID_2 AND s.rn = m.rn),
  yoy AS (SELECT GID_2, "Date", COALESCE(lag(DIR, 12) OVER {_REGION}, 0) AS h, COALESCE(d0, DIR - ahead) AS x FROM yoy_base),
  rolled AS (SELECT *, {_roll("tmin", 2)} AS tmin_roll_2, {_roll("prec", 2)} AS prec_roll_2 FROM covariate_panel),
  whole AS MATERIALIZED (
    SELECT c.*, yoy.h AS HISTORICAL_DIR, yoy.x AS DIFF_WITH_HISTORICAL_DIR, COALESCE(lag(yoy.x) OVER w, 0) AS {_DIFF},
      v AS RSI_DIR, COALESCE(lag(v) OVER w, 0) AS RSI_DIR_LAG, COALESCE(lag(v) OVER w, 0) ** 2 AS SQ_RSI_DIR_LAG,
      {", ".join(f"lag({c}_roll_2, {k}) OVER w AS {c}_roll_2_lag{k}" for c in ("tmin", "prec") for k in range(1, 5))},
      lag(SPI6, 1) OVER w AS SPI6_lag1, lag(SPI6, 2) OVER w AS SPI6_lag2, {", ".join(f"lag(TotalONI, {k}) OVER w AS TotalONI_lag{k}" for k in range(1, 5))}
    FROM rolled c JOIN yoy USING (GID_2, "Date") JOIN rsi USING (GID_2, "Date") WINDOW w AS (PARTITION BY GID_2 ORDER BY "Date")),
  knots AS (SELECT {", ".join(f"quantile_cont({c}, {[i / df for i in range(df + 1)]}) AS k_{c}" for c, (df, _) in _SPLINES.items())} FROM whole)
  SELECT GID_2, "Date", CAST(dense_rank() OVER (ORDER BY "Date") AS INTEGER) AS "TIME",
    CAST(dense_rank() OVER (ORDER BY GID_2) - 1 AS INTEGER) AS GID_2_codes, CAST(month("Date") AS INTEGER) AS "MONTH", CAST(year("Date") AS INTEGER) AS "YEAR",
    round(pop_count / 100000.0, 5) AS POP_OFFSET, CAST(month("Date") IN (12, 1, 2, 3, 4) AS INTEGER) AS SEASON,
    {", ".join(f"round({c}, 5) AS {c}" for c in _TABLE[6:] if c != "SQ_RSI_DIR_LAG")}, round(SQ_RSI_DIR_LAG, 3) AS SQ_RSI_DIR_LAG,
    {", ".join(x for c, (df, p) in _SPLINES.items() for x in _sql_basis(c, df, p))}
  FROM whole, knots""", "covariate_panel", "yoy_base", recursive=True)
def _(spark, d):
    out = climate_features.climate_feature_table(views.covariate_panel(spark, d))
    digits = {**{c: 5 for c in _TABLE[6:]}, "POP_OFFSET": 5, "SQ_RSI_DIR_LAG": 3,
              **{f"{p}_{i + 1}": 4 if i else 5 for df, p in _SPLINES.values() for i in range(df)}}
    return out.select(GID_2, DATE, "TIME", "GID_2_codes", "MONTH", "YEAR", "SEASON", *[F.round(F.col(c), n).alias(c) for c, n in digits.items()])


cte("timed_future", """
  SELECT f.*, CAST(dense_rank() OVER (ORDER BY f."Date") AS INTEGER) AS "TIME", n.pop_count / 100000.0 AS POP_OFFSET
  FROM supplier_future f LEFT JOIN population n ON n.GID_2 = f.GID_2 AND n.year = year(f."Date")""",
    "supplier_future", "population")


def _timed(spark, d):
    from epipanel.functions.scalars import population_offset
    from epipanel.operators.regions import time_index

    panel = covariates.join_population(views.supplier_future(spark, d), views.population_stats(spark, d))
    return time_index(panel).withColumn("POP_OFFSET", population_offset(F.col("pop_count")))


@query("forecast_origin", """
  SELECT CAST(min("TIME") - 1 AS INTEGER) AS origin, min("Date") AS forecast_date FROM timed_future WHERE Cases IS NULL""",
       "timed_future")
def _(spark, d):
    return climate_features.forecast_origin(_timed(spark, d))


@query("population_offset_at_origin", """
  SELECT GID_2, round(COALESCE(max(POP_OFFSET) FILTER (WHERE "TIME" = o), arg_max(POP_OFFSET, "TIME")), 6) AS POP_OFFSET
  FROM timed_future, (SELECT min("TIME") - 1 AS o FROM timed_future WHERE Cases IS NULL) GROUP BY 1""", "timed_future")
def _(spark, d):
    out = climate_features.offsets_at_origin(_timed(spark, d))
    return out.select(GID_2, F.round("POP_OFFSET", 6).alias("POP_OFFSET"))


@query("region_first_state", """
  SELECT GID_2, arg_min(GID_1, ("Date", GID_1)) AS GID_1 FROM counted_list GROUP BY 1""", "counted_list")
def _(spark, d):
    from epipanel.operators.panel import first_region_value

    return first_region_value(views.counted_list(spark, d), GID_1)
