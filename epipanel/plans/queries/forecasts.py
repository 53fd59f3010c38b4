"""Forecasts, calibration, scores and ensembles over the sample tables."""

import calendar

from pyspark.sql import functions as F

from epipanel.operators import access, baseline, calibrate, checks, covariates, ensemble, samples, scoring, summaries
from epipanel.plans import views
from epipanel.plans.catalog import cte, query
from epipanel.plans.views import sql_baseline
from epipanel.schema import CASES, DATE, FUTURE, GID_2, HORIZON, MODEL, PREDICTION, QUANTILE, QUANTILE_LEVELS

_KEY = [GID_2, DATE, HORIZON, QUANTILE]


def _tidy(df, *extra, digits=5):
    """Key columns, rounded prediction, and the named columns."""
    keys = [c for c in (MODEL, HORIZON, GID_2, DATE, QUANTILE) if c in df.columns]
    return df.select(*keys, F.round(PREDICTION, digits).alias(PREDICTION), *extra)


@query("baseline_forecast", """
  SELECT GID_2, "Date", horizon, quantile, round(prediction, 5) AS prediction, Cases, future FROM baseline_forecast""",
       "baseline_forecast")
def _(spark, d):
    return _tidy(views.baseline_forecast(spark, d), CASES, FUTURE)


cte("nation_rows", """
  SELECT GID_2, "Date", c, k, c - lag(c) OVER (PARTITION BY GID_2 ORDER BY k) AS d
  FROM (SELECT GID_2, "Date", CAST(Cases AS DOUBLE) AS c,
               CAST(row_number() OVER (PARTITION BY GID_2 ORDER BY "Date") - 1 AS INTEGER) AS k FROM nation_panel)""",
    "nation_panel")
cte("drifting_forecast", sql_baseline("nation_rows", "[1, 2, 3]", "d.d", "(horizon - 1) * {median}").replace(
    "CROSS JOIN (VALUES (1), (-1)) g(sgn)", ""), "nation_rows")


@query("baseline_forecast_drifting", """
  SELECT GID_2, "Date", horizon, quantile, round(prediction, 5) AS prediction, Cases FROM drifting_forecast""",
       "drifting_forecast")
def _(spark, d):
    return _tidy(baseline.baseline(views.nation_panel(spark, d), horizon=3, symmetrize=False), CASES)


cte("future_rows", """
  SELECT GID_2, "Date", future, c, k, CASE WHEN k >= 1 THEN COALESCE(c - lag(c) OVER (PARTITION BY GID_2 ORDER BY k), 0) END AS d
  FROM (SELECT GID_2, "Date", future, CAST(Cases AS DOUBLE) AS c,
               CAST(row_number() OVER (PARTITION BY GID_2 ORDER BY "Date") - 1 AS INTEGER) AS k FROM supplier_future)""",
    "supplier_future")
cte("future_draws", """
  SELECT t.GID_2, t."Date", t.k, any_value(l.c) AS lvl, any_value(t.future) AS future,
         quantile_cont(s * d.d, [499 / 999.0, 500 / 999.0]) AS q
  FROM future_rows t JOIN future_rows l ON l.GID_2 = t.GID_2 AND l.k = t.k - 1
  JOIN future_rows d ON d.GID_2 = t.GID_2 AND d.k BETWEEN 1 AND t.k - 2, (VALUES (1), (-1)) v(s)
  WHERE t.k >= 3 GROUP BY 1, 2, 3""", "future_rows")


@query("baseline_future_median", """
  , chain AS (
    SELECT GID_2, "Date", k, future, (greatest(lvl + (q[1] - q[2]) / 2, 0) + greatest(lvl + (q[2] - q[1]) / 2, 0)) / 2 AS m
    FROM future_draws z WHERE lvl IS NOT NULL
    UNION ALL
    SELECT n.GID_2, n."Date", n.k, n.future,
      (greatest(c.m + (n.q[1] - n.q[2]) / 2, 0) + greatest(c.m + (n.q[2] - n.q[1]) / 2, 0)) / 2
    FROM chain c JOIN future_draws n ON n.GID_2 = c.GID_2 AND n.k = c.k + 1 AND n.lvl IS NULL)
  SELECT GID_2, "Date", round(m, 5) AS prediction FROM chain WHERE future""", "future_draws", recursive=True)
def _(spark, d):
    out = baseline.baseline(views.supplier_future(spark, d), horizon=1)
    return access.pick(access.future(out), quantile=0.5).select(GID_2, DATE, F.round(PREDICTION, 5).alias(PREDICTION))


@query("seasonal_average", """
  SELECT GID_2, "Date", Cases, false AS future, CAST(0 AS INTEGER) AS sample,
         round(CASE WHEN "Date" >= start THEN avg5 END, 6) AS prediction FROM (
    SELECT GID_2, "Date", CAST(Cases AS DOUBLE) AS Cases,
      (SELECT min("Date") FROM nation_panel) AS start,
      (COALESCE(lag(Cases, 12) OVER w, 0) + COALESCE(lag(Cases, 24) OVER w, 0) + COALESCE(lag(Cases, 36) OVER w, 0)
       + COALESCE(lag(Cases, 48) OVER w, 0) + COALESCE(lag(Cases, 60) OVER w, 0)) / 5 AS avg5
    FROM nation_panel WINDOW w AS (PARTITION BY GID_2 ORDER BY "Date"))""", "nation_panel")
def _(spark, d):
    panel = views.nation_panel(spark, d).withColumn(FUTURE, F.lit(False))
    return baseline.seasonal_average(panel).withColumn(PREDICTION, F.round(PREDICTION, 6))


cte("sample_quantiles", """
  SELECT GID_2, "Date", Cases, n_up, n_down, s FROM (
    SELECT GID_2, "Date", max(Cases) AS Cases,
      row_number() OVER (PARTITION BY GID_2 ORDER BY "Date") AS n_up,
      row_number() OVER (PARTITION BY GID_2 ORDER BY "Date" DESC) AS n_down,
      quantile_cont(prediction, [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS s
    FROM forecast_samples GROUP BY 1, 2)""", "forecast_samples")


@query("samples_to_quantiles", """
  SELECT GID_2, "Date", Cases,
    unnest(CAST([0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99] AS DOUBLE[])) AS quantile,
    round(unnest(s), 6) AS prediction
  FROM sample_quantiles WHERE n_up > 2 AND n_down > 1""", "sample_quantiles")
def _(spark, d):
    out = samples.samples_to_quantiles(views.forecast_samples(spark, d))
    return _tidy(out, CASES, digits=6)


@query("hot_group_quantiles", """
  SELECT event_type, unnest(CAST([0.05, 0.5, 0.95] AS DOUBLE[])) AS quantile,
         round(unnest(quantile_cont(value, [0.05, 0.5, 0.95])), 6) AS value FROM events GROUP BY 1""")
def _(spark, d):
    from epipanel.operators.quantiles import exact_quantiles

    out = exact_quantiles(views.table(spark, d, "events"), ["event_type"], "value", [0.05, 0.5, 0.95])
    return out.withColumn("value", F.round("value", 6))


@query("median_of_samples", """
  SELECT GID_2, "Date", round(median(prediction), 6) AS prediction FROM forecast_samples GROUP BY 1, 2""", "forecast_samples")
def _(spark, d):
    out = samples.median_of_samples(views.forecast_samples(spark, d))
    return out.withColumn(PREDICTION, F.round(PREDICTION, 6))


@query("median_on_panel", """
  SELECT p.GID_2, p."Date", p.Cases, round(m.prediction, 5) AS prediction FROM supplier_panel p
  LEFT JOIN (SELECT * FROM baseline_forecast WHERE horizon = 1 AND quantile = 0.5) m
    ON m.GID_2 = p.GID_2 AND m."Date" = p."Date" """, "supplier_panel", "baseline_forecast")
def _(spark, d):
    out = covariates.attach_median(views.supplier_panel(spark, d), views.baseline_forecast(spark, d))
    return out.select(GID_2, DATE, CASES, F.round(PREDICTION, 5).alias(PREDICTION))


@query("forecast_with_cases", """
  SELECT f.GID_2, f."Date", f.horizon, f.quantile, round(f.prediction, 5) AS prediction, p.Cases
  FROM baseline_forecast f LEFT JOIN supplier_panel p ON p.GID_2 = f.GID_2 AND p."Date" = f."Date"
  """, "baseline_forecast", "supplier_panel")
def _(spark, d):
    out = covariates.attach_cases(views.baseline_forecast(spark, d), views.supplier_panel(spark, d))
    return _tidy(out, CASES)


def _sql_wis(source, pred, truth, keys):
    return f"""
  SELECT {keys}, CASE WHEN count(p) = count(*) THEN sum(CASE WHEN y >= p THEN q * (y - p) ELSE (q - 1) * (y - p) END)
         / (0.5 + sum(CASE WHEN q < 0.5 THEN q ELSE 0 END)) END AS WIS, max(y) AS Cases
  FROM (SELECT {keys}, quantile AS q, {truth} AS y,
          CASE WHEN {pred} IS NOT NULL THEN max({pred}) OVER (PARTITION BY {keys} ORDER BY quantile) END AS p FROM {source})
  GROUP BY {keys}"""


cte("log_wis", _sql_wis("model_forecasts", "ln(1 + prediction)", "ln(1 + Cases)", 'model, horizon, GID_2, "Date"'),
    "model_forecasts")
cte("raw_wis", _sql_wis("baseline_forecast", "greatest(prediction, 0)", "Cases", 'horizon, GID_2, "Date"').replace(
    "CASE WHEN greatest(prediction, 0) IS NOT NULL", "CASE WHEN prediction IS NOT NULL"), "baseline_forecast")


@query("wis_by_model_and_horizon", """
  SELECT model, horizon, GID_2, "Date", round(WIS, 6) AS WIS, round(Cases, 6) AS Cases FROM log_wis""", "log_wis")
def _(spark, d):
    out = scoring.model_wis(views.model_forecasts(spark, d))
    return out.withColumns({"WIS": F.round("WIS", 6), CASES: F.round(CASES, 6)})


@query("wis_at_standard_levels", """
  SELECT model, horizon, GID_2, "Date", round(WIS, 6) AS WIS, round(Cases, 6) AS Cases FROM log_wis""", "log_wis")
def _(spark, d):
    out = scoring.model_wis(views.model_forecasts(spark, d), QUANTILE_LEVELS)
    return out.withColumns({"WIS": F.round("WIS", 6), CASES: F.round(CASES, 6)})


@query("wis_counts", 'SELECT horizon, GID_2, "Date", round(WIS, 6) AS WIS, Cases FROM raw_wis', "raw_wis")
def _(spark, d):
    return scoring.wis(views.baseline_forecast(spark, d)).withColumn("WIS", F.round("WIS", 6))


def _sql_scores(keys, y="Cases", p="prediction"):
    return f"""round(1 - sum(({y} - {p}) ** 2) / nullif(var_pop({y}) * count(*), 0), 6) AS R2,
               round(sqrt(avg(({y} - {p}) ** 2)), 6) AS RMSE"""


@query("r2_rmse_overall", f"""
  SELECT {_sql_scores("")} FROM model_forecasts WHERE prediction IS NOT NULL AND quantile = 0.5 AND model = 'high'""",
       "model_forecasts")
def _(spark, d):
    rows = access.pick(access.filter_equal(views.model_forecasts(spark, d), {MODEL: "high"}), quantile=0.5)
    one, two = scoring.r2(rows), scoring.rmse(rows)
    return one.withColumn("RMSE", two.scalar()).select(F.round("R2", 6).alias("R2"), F.round("RMSE", 6).alias("RMSE"))


cte("region_scores", f"""
  SELECT model, horizon, GID_2, {_sql_scores("")} FROM model_forecasts
  WHERE prediction IS NOT NULL AND quantile = 0.5 GROUP BY 1, 2, 3""", "model_forecasts")


@query("r2_rmse_by_region", "SELECT * FROM region_scores", "region_scores")
def _(spark, d):
    out = scoring.point_scores(views.model_forecasts(spark, d), keys=[MODEL, HORIZON, GID_2])
    return out.withColumns({"R2": F.round("R2", 6), "RMSE": F.round("RMSE", 6)})


@query("regression_table", """
  SELECT model, horizon, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS R2,
         round(exp(sqrt(avg((y - p) ** 2))) - 1, 6) AS RMSE
  FROM (SELECT model, horizon, "Date", ln(1 + avg(Cases)) AS y, ln(1 + avg(prediction)) AS p FROM model_forecasts
        WHERE quantile = 0.5 GROUP BY 1, 2, 3) WHERE p IS NOT NULL GROUP BY 1, 2""", "model_forecasts")
def _(spark, d):
    out = scoring.regression_table(views.model_forecasts(spark, d))
    return out.withColumns({"R2": F.round("R2", 6), "RMSE": F.round("RMSE", 6)})


@query("regional_means", """
  SELECT horizon, "Date", round(avg(Cases), 6) AS Cases, round(avg(prediction), 5) AS prediction
  FROM baseline_forecast WHERE quantile = 0.5 GROUP BY 1, 2""", "baseline_forecast")
def _(spark, d):
    out = scoring.regional_mean(access.pick(views.baseline_forecast(spark, d), quantile=0.5), [HORIZON])
    return out.withColumns({CASES: F.round(CASES, 6), PREDICTION: F.round(PREDICTION, 5)})


cte("region_wis", "SELECT model, horizon, GID_2, round(avg(WIS), 6) AS WIS FROM log_wis GROUP BY 1, 2, 3", "log_wis")


def _region_scores(spark, d):
    """R2, RMSE and mean WIS of every region."""
    keys = [MODEL, HORIZON, GID_2]
    forecasts = views.model_forecasts(spark, d)
    wis = scoring.model_wis(forecasts, QUANTILE_LEVELS).groupBy(*keys).agg(F.round(F.avg("WIS"), 6).alias("WIS"))
    points = scoring.point_scores(forecasts, keys=keys).withColumns({c: F.round(c, 6) for c in ("R2", "RMSE")})
    return points.join(wis, keys, "full")


def _sql_distribution(metric: str, source: str) -> str:
    return f"""
  SELECT model, horizon, '{metric}' AS metric, round(avg({metric}), 5) AS mean, round(stddev_samp({metric}), 5) AS std,
    round(quantile_cont({metric}, 0.25), 5) AS q25, round(quantile_cont({metric}, 0.5), 5) AS q50,
    round(quantile_cont({metric}, 0.75), 5) AS q75
  FROM {source} GROUP BY 1, 2"""


@query("score_distribution", " UNION ALL ".join([
    _sql_distribution("RMSE", "region_scores"), _sql_distribution("R2", "region_scores"), _sql_distribution("WIS", "region_wis")]),
       "region_scores", "region_wis")
def _(spark, d):
    out = scoring.score_distribution(_region_scores(spark, d), ["R2", "RMSE", "WIS"])
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "std", "q25", "q50", "q75")})


cte("raw_compared", """
  SELECT b.GID_2, b."Date", b.horizon, b.WIS AS WIS_base, a.WIS AS WIS_adjusted, a.WIS - b.WIS AS delta_WIS
  FROM (SELECT * FROM log_wis WHERE model = 'base') b JOIN (SELECT * FROM log_wis WHERE model = 'low') a
    ON a.GID_2 = b.GID_2 AND a."Date" = b."Date" AND a.horizon = b.horizon""", "log_wis")


def _compared(spark, d):
    scores = scoring.model_wis(views.model_forecasts(spark, d), QUANTILE_LEVELS)
    return scoring.compare_scores(scores.where("model = 'base'"), scores.where("model = 'low'"), ["WIS"])


@query("wis_change", """
  SELECT GID_2, "Date", horizon, round(delta_WIS, 6) AS delta_WIS, CAST(sign(round(delta_WIS, 9)) AS DOUBLE) AS sign_WIS
  FROM raw_compared""", "raw_compared")
def _(spark, d):
    return _compared(spark, d).select(
        GID_2, DATE, HORIZON, F.round("delta_WIS", 6).alias("delta_WIS"),
        F.signum(F.round("delta_WIS", 9)).alias("sign_WIS"))


@query("mean_wis_by_region", """
  SELECT GID_2, round(avg(WIS_base), 6) AS WIS_base, round(avg(WIS_adjusted), 6) AS WIS_adjusted
  FROM raw_compared GROUP BY 1""", "raw_compared")
def _(spark, d):
    out = scoring.mean_wis_by_region(_compared(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("WIS_base", "WIS_adjusted")})


cte("horizon_scores", """
  SELECT * FROM (SELECT model, horizon, avg(R2) AS R2, avg(RMSE) AS RMSE FROM region_scores GROUP BY 1, 2)
    JOIN (SELECT model, horizon, avg(WIS) AS WIS FROM region_wis GROUP BY 1, 2) USING (model, horizon)""", "region_scores", "region_wis")


@query("score_change_by_horizon", """
  SELECT b.horizon, round(a.R2 - b.R2, 5) AS delta_R2, round(a.RMSE - b.RMSE, 5) AS delta_RMSE, round(a.WIS - b.WIS, 5) AS delta_WIS
  FROM (SELECT * FROM horizon_scores WHERE model = 'base') b JOIN (SELECT * FROM horizon_scores WHERE model = 'high') a USING (horizon)""",
       "horizon_scores")
def _(spark, d):
    metrics = ["R2", "RMSE", "WIS"]
    mean = _region_scores(spark, d).groupBy(MODEL, HORIZON).agg(*[F.avg(m).alias(m) for m in metrics])
    out = summaries.delta_by_horizon(mean.where("model = 'base'"), mean.where("model = 'high'"), metrics)
    return out.withColumns({f"delta_{m}": F.round(f"delta_{m}", 5) for m in metrics})


@query("pinball_by_model", """
  SELECT model, horizon, round(sum(l), 6) AS loss FROM (
    SELECT model, horizon, quantile, avg(CASE WHEN Cases >= prediction THEN quantile * (Cases - prediction)
      ELSE (quantile - 1) * (Cases - prediction) END) AS l
    FROM model_forecasts WHERE prediction IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""", "model_forecasts")
def _(spark, d):
    out = scoring.mean_pinball(views.model_forecasts(spark, d), [MODEL, HORIZON])
    return out.withColumn("loss", F.round("loss", 6))


@query("outlier_regions", """
  SELECT horizon, GID_2, bool_or(prediction IS NULL) AS has_null, COALESCE(bool_or(prediction > 600), false) AS too_large
  FROM baseline_forecast GROUP BY 1, 2 HAVING has_null OR too_large""", "baseline_forecast")
def _(spark, d):
    return checks.outlier_regions(views.baseline_forecast(spark, d), limit=600)


@query("forecast_totals", """
  SELECT "Date", sum(CASE WHEN quantile = 0.5 THEN Cases END) AS Cases,
    round(sum(CASE WHEN quantile = 0.05 THEN prediction END), 4) AS low,
    round(sum(CASE WHEN quantile = 0.5 THEN prediction END), 4) AS median,
    round(sum(CASE WHEN quantile = 0.95 THEN prediction END), 4) AS high
  FROM baseline_forecast WHERE horizon = 1 GROUP BY 1""", "baseline_forecast")
def _(spark, d):
    out = summaries.forecast_totals(views.baseline_forecast(spark, d), horizon=1)
    return out.withColumns({c: F.round(c, 4) for c in ("low", "median", "high")})


MONTHS = [f"{y}-{m:02d}-{calendar.monthrange(y, m)[1]}" for y in range(1995, 2002) for m in range(1, 13)]


@query("median_matrix", "SELECT GID_2, " + ", ".join(
    f"""round(max(CASE WHEN "Date" = DATE '{m}' THEN prediction END), 5) AS "{m}\"""" for m in MONTHS)
    + " FROM baseline_forecast WHERE quantile = 0.5 AND horizon = 1 GROUP BY 1", "baseline_forecast")
def _(spark, d):
    out = summaries.median_matrix(views.baseline_forecast(spark, d), 1, MONTHS)
    return out.select(GID_2, *[F.round(F.col(f"`{m}`"), 5).alias(m) for m in MONTHS])


@query("melted_quantiles", """
  SELECT GID_2, "Date", horizon, quantile, round(prediction, 5) AS prediction FROM baseline_forecast WHERE quantile IN (0.05, 0.5, 0.95)
  UNION ALL SELECT GID_2, "Date", h, q, NULL FROM (SELECT DISTINCT GID_2, "Date", horizon AS h FROM baseline_forecast WHERE prediction IS NULL),
    (SELECT unnest(CAST([0.05, 0.95] AS DOUBLE[])) AS q)""", "baseline_forecast")
def _(spark, d):
    logged = views.baseline_forecast(spark, d).withColumn(PREDICTION, F.log1p(PREDICTION))
    wide = samples.widen(logged, [0.05, 0.5, 0.95])
    return _tidy(samples.melt_quantiles(wide, [HORIZON, GID_2, DATE]))


cte("errors", """
  SELECT horizon, GID_2, "Date", Cases, ln(1 + prediction) AS base, ln(1 + Cases) - ln(1 + prediction) AS e
  FROM baseline_forecast WHERE quantile = 0.5""", "baseline_forecast")


def _sql_residual(own_frame, pooled, least, window=None):
    have = f"least(count(e) OVER (PARTITION BY horizon, GID_2 ORDER BY \"Date\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {window})" \
        if window else 'count(e) OVER (PARTITION BY horizon, GID_2 ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'
    return f"""
  SELECT GID_2, "Date", horizon, unnest({views._LEVELS}) AS quantile, Cases,
    round(unnest(list_transform(CASE WHEN have >= {least} THEN own WHEN n >= {least} THEN pooled
      ELSE list_transform({views._LEVELS}, lambda z: 0.0::DOUBLE) END, lambda v: CASE WHEN base IS NOT NULL THEN greatest(exp(base + v) - 1, 0) END)) + 1e-7, 5) AS prediction
  FROM (SELECT *, {have} AS have,
          quantile_cont(e, {views._LEVELS}) OVER (PARTITION BY horizon, GID_2 ORDER BY "Date" ROWS BETWEEN {own_frame} PRECEDING AND 1 PRECEDING) AS own
        FROM errors) a
  LEFT JOIN ({pooled}) b USING (horizon, "Date")"""


_POOLED_ALL = f"""
    SELECT c.horizon, c."Date", count(p.e) AS n, quantile_cont(p.e, {views._LEVELS}) AS pooled
    FROM (SELECT DISTINCT horizon, "Date" FROM errors) c JOIN errors p ON p.horizon = c.horizon AND p."Date" < c."Date"
    WHERE p.e IS NOT NULL GROUP BY 1, 2"""
_POOLED_LAST = f"""
    SELECT horizon, "Date", count(e) AS n, quantile_cont(e, {views._LEVELS}) AS pooled FROM (
      SELECT c.horizon, c."Date", p.e, row_number() OVER (PARTITION BY c.horizon, c."Date" ORDER BY p."Date" DESC, p.GID_2 DESC) AS r
      FROM (SELECT DISTINCT horizon, "Date" FROM errors) c JOIN errors p ON p.horizon = c.horizon AND p."Date" < c."Date"
      WHERE p.e IS NOT NULL) WHERE r <= 24 GROUP BY 1, 2"""


def _off_ties(df):
    """Many values are dyadic and would sit just between two roundings."""
    return df.withColumn(PREDICTION, F.col(PREDICTION) + 1e-7)


@query("residual_quantiles", _sql_residual("UNBOUNDED", _POOLED_ALL, 20), "errors")
def _(spark, d):
    return _tidy(_off_ties(calibrate.calibrate_forecast(views.baseline_forecast(spark, d))), CASES)


@query("residual_quantiles_moving", _sql_residual("24", _POOLED_LAST, 18, 24), "errors")
def _(spark, d):
    return _tidy(_off_ties(calibrate.calibrate_forecast(views.baseline_forecast(spark, d), window=24, min_history=18)), CASES)


cte("unsorted", """
  SELECT * REPLACE (prediction + CASE WHEN quantile = 0.3 THEN 5 ELSE 0 END AS prediction) FROM baseline_forecast""", "baseline_forecast")


def _unsorted(spark, d):
    bump = F.when(F.col(QUANTILE) == 0.3, 5).otherwise(0)
    return views.baseline_forecast(spark, d).withColumn(PREDICTION, F.col(PREDICTION) + bump)


@query("monotone_quantiles", """
  SELECT GID_2, "Date", horizon, quantile, round(CASE WHEN prediction IS NOT NULL THEN max(prediction) OVER
    (PARTITION BY horizon, GID_2, "Date" ORDER BY quantile) END, 5) AS prediction FROM unsorted""", "unsorted")
def _(spark, d):
    return _tidy(calibrate.monotone_quantiles(_unsorted(spark, d)))


@query("tiny_violations_lifted", """
  SELECT GID_2, "Date", horizon, unnest(levels) AS quantile, round(unnest(lifted), 5) AS prediction FROM (
    SELECT GID_2, "Date", horizon, list(quantile ORDER BY quantile) AS levels,
      list_reduce(list([prediction] ORDER BY quantile), lambda done, p: list_append(done,
        CASE WHEN p[1] < done[-1] AND done[-1] - p[1] <= 2.5 THEN done[-1] ELSE p[1] END)) AS lifted
    FROM unsorted GROUP BY 1, 2, 3)""", "unsorted")
def _(spark, d):
    return _tidy(calibrate.lift_tiny_violations(_unsorted(spark, d), 2.5))


def _sql_weights(n: int, step: float, passes: int) -> str:
    """The weight search in SQL: its passes one after another; those after the last move change nothing. Registers the expressions."""
    mix = " + ".join(f"w[{i + 1}] * p{i}" for i in range(n))
    over = "(PARTITION BY horizon, i ORDER BY \"Date\")"
    slopes = ", ".join(f"round(sum(g{i}) OVER {over} / sum(n) OVER {over}, 9)" for i in range(n))

    def score(name: str, wanted: str, *needs: str) -> None:
        cte(f"{name}_points", f"""SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY w) AS i
          FROM (SELECT horizon, w, max("Date") AS last FROM ({wanted}) GROUP BY horizon, w)""", *needs)
        cte(f"{name}_daily", f"""SELECT horizon, i, "Date", sum(CASE WHEN y >= mix THEN q * (y - mix) ELSE (q - 1) * (y - mix) END) AS l, count(*) AS n,
            {', '.join(f'sum(CASE WHEN y >= mix - 1e-9 THEN -q ELSE 1 - q END * p{i}) AS g{i}' for i in range(n))}
          FROM (SELECT v.*, i, {mix} AS mix FROM six_wide v JOIN {name}_points USING (horizon) WHERE "Date" <= last) GROUP BY ALL""",
            f"{name}_points", "six_wide")
        cte(f"{name}_scored", f"""SELECT horizon, "Date", w, loss, slope FROM (
            SELECT horizon, i, "Date", round(sum(l) OVER {over} / sum(n) OVER {over}, 9) AS loss, [{slopes}] AS slope FROM {name}_daily)
          JOIN {name}_points USING (horizon, i)""", f"{name}_daily")

    starts = [[1.0 / n] * n, *[[float(i == j) for j in range(n)] for i in range(n)]]
    score("start", f"""SELECT horizon, "Date", unnest(CAST({starts} AS DOUBLE[][])) AS w FROM (SELECT DISTINCT horizon, "Date" FROM six_wide)""", "six_wide")
    rank = f"CASE WHEN w[1] = {1.0 / n!r} THEN 0 ELSE list_position(w, 1.0) END"
    moved = "list_transform(w, lambda x, i: round(CASE WHEN i = target THEN x + least(h, w[source]) WHEN i = source THEN x - least(h, w[source]) ELSE x END, 12))"
    before = f"""SELECT horizon, "Date", w, loss, slope, 0.5::DOUBLE AS h, false AS done FROM (
        SELECT *, row_number() OVER (PARTITION BY horizon, "Date" ORDER BY round(loss, 7), {rank}) AS r FROM start_scored) WHERE r = 1"""
    needs = "start_scored"
    for k in range(passes):
        cte(f"state{k}", f"""SELECT * EXCLUDE (held, source, target), CASE WHEN NOT done AND list_max(held) > list_min(slope) + 1e-8 THEN {moved} END AS nxt FROM (
            SELECT *, list_position(list_transform(held, lambda g: g >= list_max(held) - 1e-8), true) AS source,
              list_position(list_transform(slope, lambda g: g <= list_min(slope) + 1e-8), true) AS target FROM (
              SELECT *, list_transform(w, lambda x, i: CASE WHEN x > 0 THEN slope[i] END) AS held FROM ({before})))""", needs)
        score(f"pass{k}", f"""SELECT horizon, "Date", nxt AS w FROM state{k} WHERE nxt IS NOT NULL""", f"state{k}")
        better = "coalesce(t.loss < s.loss - 1e-8, false)"
        before = f"""SELECT s.horizon, s."Date", CASE WHEN {better} THEN nxt ELSE s.w END AS w, CASE WHEN {better} THEN t.loss ELSE s.loss END AS loss,
            CASE WHEN {better} THEN t.slope ELSE s.slope END AS slope, CASE WHEN {better} OR done THEN h ELSE h / 2 END AS h,
            done OR nxt IS NULL OR (NOT {better} AND h <= {step}) AS done
          FROM state{k} s LEFT JOIN pass{k}_scored t ON s.horizon = t.horizon AND s."Date" = t."Date" AND s.nxt = t.w"""
        needs = f"pass{k}_scored"
    return before


_SIX = views.SIX_MODELS
_PASSES = 24  # as many as the operator makes at most
cte("best_weights", f"""SELECT horizon, "Date", {', '.join(f'w[{i + 1}] AS {m}' for i, m in enumerate(_SIX))}
  FROM ({_sql_weights(len(_SIX), 0.05, _PASSES)})""", f"pass{_PASSES - 1}_scored")


def _stacked(spark, d):
    return ensemble.stack_models(views.six_forecasts(spark, d))


@query("ensemble_weights", f"""
  SELECT horizon, "Date", {', '.join(f'round({m}, 6) AS {m}' for m in _SIX)} FROM best_weights""", "best_weights")
def _(spark, d):
    wide = ensemble.weights_wide(ensemble.train_weights(_stacked(spark, d), _SIX, step=0.05), _SIX)
    return wide.select(HORIZON, DATE, *[F.round(m, 6).alias(m) for m in _SIX])


@query("ensemble_forecast", f"""
  SELECT GID_2, v."Date", v.horizon, q AS quantile, 'ensemble' AS model, w.base IS NOT NULL AS ensemble_ready,
    round(CASE WHEN w.base IS NULL THEN p0 ELSE {' + '.join(f'w.{m} * p{i}' for i, m in enumerate(_SIX))} END + 1e-7, 5) AS prediction, y AS Cases
  FROM six_wide v LEFT JOIN (SELECT * REPLACE (lead("Date") OVER (PARTITION BY horizon ORDER BY "Date") AS "Date") FROM best_weights) w
    ON w.horizon = v.horizon AND w."Date" = v."Date" """, "best_weights", "six_wide")
def _(spark, d):
    out, _weights = ensemble.create_ensemble(views.six_forecasts(spark, d), step=0.05)
    return _tidy(_off_ties(out), CASES, "ensemble_ready")


@query("fixed_weight_ensemble", """
  SELECT GID_2, "Date", horizon, quantile, round((prediction + (prediction * 1.25 + 1) + (prediction * 0.7)) / 3, 5) AS prediction,
    Cases FROM baseline_forecast""", "baseline_forecast")
def _(spark, d):
    out = ensemble.combine_fixed(views.model_forecasts(spark, d), {"base": 1.0, "high": 1.0, "low": 1.0})
    return _tidy(out, CASES)


@query("smoothed_weights", f"""
  SELECT horizon, "Date", model, round(avg(weight) OVER (PARTITION BY horizon, model ORDER BY "Date"
    ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS weight
  FROM (UNPIVOT best_weights ON {', '.join(_SIX)} INTO NAME model VALUE weight)""", "best_weights")
def _(spark, d):
    weights = ensemble.train_weights(_stacked(spark, d), _SIX, step=0.05)
    return ensemble.smooth_weights(weights, 6).select(HORIZON, DATE, MODEL, F.round("weight", 6).alias("weight"))


cte("partial_models", """
  SELECT * FROM model_forecasts WHERE NOT (model = 'low' AND ("Date" < DATE '1996-01-01' OR quantile = 0.01))
    AND NOT (model = 'high' AND GID_2 LIKE 'TST.3.%')""", "model_forecasts")


def _partial(spark, d):
    return views.model_forecasts(spark, d).where(
        "NOT (model = 'low' AND (Date < DATE '1996-01-01' OR quantile = 0.01)) AND NOT (model = 'high' AND GID_2 LIKE 'TST.3.%')")


@query("common_levels_and_dates", """
  SELECT model, horizon, GID_2, "Date", quantile FROM partial_models
  WHERE quantile IN (SELECT quantile FROM partial_models GROUP BY 1 HAVING count(DISTINCT model) = 3)
    AND (horizon, "Date") IN (SELECT (horizon, "Date") FROM partial_models GROUP BY horizon, "Date" HAVING count(DISTINCT model) = 3)""",
       "partial_models")
def _(spark, d):
    return ensemble.common_part(_partial(spark, d), 3).select(MODEL, HORIZON, GID_2, DATE, QUANTILE)


@query("common_regions", """
  SELECT model, horizon, GID_2, count(*) AS n FROM partial_models
  WHERE GID_2 IN (SELECT GID_2 FROM partial_models GROUP BY 1 HAVING count(DISTINCT model) = 3) GROUP BY 1, 2, 3""", "partial_models")
def _(spark, d):
    return checks.rows_per(ensemble.common_regions(_partial(spark, d), 3), MODEL, HORIZON, GID_2)
