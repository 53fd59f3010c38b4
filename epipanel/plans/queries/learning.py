"""Back-tests and regressions over the sample tables."""

from pyspark.sql import functions as F

from epipanel.operators import access, backtest, boosting, features, harness, residual_regression
from epipanel.plans import views
from epipanel.plans.catalog import cte, query
from epipanel.schema import CASES, DATE, FUTURE, GID_2, HORIZON, PREDICTION, QUANTILE


def region_embeddings(spark, d):
    """Embedding vectors of the suppliers' regions."""
    ids = views.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("vec_id"), F.format_string("TST.%d.%d_1", F.col("s_suppkey") % 25, F.col("s_suppkey")).alias(GID_2))
    return ids.join(views.table(spark, d, "embeddings"), "vec_id").select(GID_2, "embedding")


def _known(spark, d, forecast):
    from epipanel.operators.covariates import keep_regions_with

    return keep_regions_with(forecast, region_embeddings(spark, d))


cte("ar_rows", """
  SELECT GID_2, "Date", row_number() OVER w AS t, Cases, ln(1 + Cases) AS y, lag(ln(1 + Cases), 1) OVER w AS x1,
    lag(ln(1 + Cases), 12) OVER w AS x2, lag(ln(1 + Cases), 13) OVER w AS x3
  FROM nation_panel WINDOW w AS (PARTITION BY GID_2 ORDER BY "Date")""", "nation_panel")
_N = "count(*)"


def _c(a, b):
    return f"covar_pop({a}, {b})"


def _det(m):
    (a, b, c), (e, f, g), (h, i, j) = m
    return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {c} * ({e} * {i} - {f} * {h}))"


_S = [[f"s{min(i, j)}{max(i, j)}" for j in (1, 2, 3)] for i in (1, 2, 3)]
_COLS = [[[("r" + str(r + 1)) if c == k else _S[r][c] for c in range(3)] for r in range(3)] for k in range(3)]

cte("ar_fits", f"""
  SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (
    SELECT *, {", ".join(f"{_det(_COLS[k])} / det AS b{k + 1}" for k in range(3))} FROM (
      SELECT *, {_det(_S)} AS det FROM (
        SELECT c.t AS f, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,
          {", ".join(f"{_c(f'x{i}', f'x{j}')} AS s{i}{j}" for i in (1, 2, 3) for j in range(i, 4))},
          {", ".join(f"{_c(f'x{i}', 'y')} AS r{i}" for i in (1, 2, 3))}
        FROM (SELECT DISTINCT t FROM ar_rows) c JOIN ar_rows p ON p.t <= c.t WHERE x3 IS NOT NULL GROUP BY 1)))""", "ar_rows")


@query("seasonal_autoregression_pooled", """
  SELECT GID_2, "Date", CAST(1 AS INTEGER) AS horizon, Cases,
         round(greatest(exp(b0 + b1 * x1 + b2 * x2 + b3 * x3) - 1, 0), 4) AS prediction
  FROM ar_rows r JOIN ar_fits f ON f.f = r.t - 1 WHERE x3 IS NOT NULL AND n > 4""", "ar_rows", "ar_fits")
def _(spark, d):
    out = backtest.seasonal_autoregression(views.nation_panel(spark, d), level=0)
    return out.withColumn(PREDICTION, F.round(PREDICTION, 4))


cte("ar_fits_by_region", f"""
  SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (
    SELECT *, {", ".join(f"{_det(_COLS[k])} / det AS b{k + 1}" for k in range(3))} FROM (
      SELECT *, {_det(_S)} AS det FROM (
        SELECT c.GID_2, c.t AS f, count(*) AS n, avg(p.y) AS my, avg(p.x1) AS m1, avg(p.x2) AS m2, avg(p.x3) AS m3,
          {", ".join(f"{_c(f'p.x{i}', f'p.x{j}')} AS s{i}{j}" for i in (1, 2, 3) for j in range(i, 4))},
          {", ".join(f"{_c(f'p.x{i}', 'p.y')} AS r{i}" for i in (1, 2, 3))}
        FROM ar_rows c JOIN ar_rows p ON p.GID_2 = c.GID_2 AND p.t <= c.t WHERE p.x3 IS NOT NULL GROUP BY 1, 2)))""",
    "ar_rows")


@query("seasonal_autoregression_by_region", """
  SELECT GID_2, "Date", CAST(1 AS INTEGER) AS horizon, Cases,
         round(greatest(exp(b0 + b1 * x1 + b2 * x2 + b3 * x3) - 1, 0), 3) AS prediction
  FROM ar_rows r JOIN ar_fits_by_region f USING (GID_2) WHERE f.f = r.t - 1 AND x3 IS NOT NULL AND n > 4 AND det > 1e-12""",
       "ar_rows", "ar_fits_by_region")
def _(spark, d):
    out = backtest.seasonal_autoregression(views.nation_panel(spark, d), level=2)
    return out.withColumn(PREDICTION, F.round(PREDICTION, 3))


cte("walk_rows", """
  SELECT GID_2, "Date", Cases, row_number() OVER w AS k, avg(ln(1 + Cases)) OVER
    (PARTITION BY GID_2 ORDER BY "Date" ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) AS m
  FROM supplier_panel WINDOW w AS (PARTITION BY GID_2 ORDER BY "Date")""", "supplier_panel")


@query("series_backtest", """
  SELECT GID_2, "Date", CAST(2 AS INTEGER) AS horizon, CAST(Cases AS DOUBLE) AS Cases, round(greatest(exp(m) - 1, 0), 5) AS prediction
  FROM walk_rows WHERE k >= 5""", "walk_rows")
def _(spark, d):
    out = backtest.backtest_series(
        views.supplier_panel(spark, d), fit=lambda y: None, predict=lambda state, y, h: y[-3:].mean(), horizons=(2,))
    return out.withColumn(PREDICTION, F.round(PREDICTION, 5))


def nation_covariates(spark, d):
    """Nation panel with two monthly means of its line items as covariates."""
    items = views.table(spark, d, "lineitem").groupBy(F.last_day(F.to_date("l_shipdate")).alias(DATE)).agg(
        F.avg("l_discount").alias("tmin"), F.avg("l_tax").alias("prec"))
    return views.nation_panel(spark, d).join(items, DATE, "left")


cte("nation_covariates", """
  SELECT p.*, m.tmin, CAST(year(p."Date") * 12 + month(p."Date") AS INTEGER) AS t, ln(1 + Cases) AS y FROM nation_panel p LEFT JOIN (
    SELECT last_day(CAST(l_shipdate AS DATE)) AS "Date", avg(l_discount) AS tmin FROM lineitem GROUP BY 1) m USING ("Date")""", "nation_panel")
_FIRST, _EVERY = 24, 6  # dates of the first fit, months between fits


def _sql_smoothing(group: str) -> str:
    """Profile and slope per group and fit time, and the smoothed level of each region at each origin, as a weighted sum of its history."""
    return f"""
  WITH lo AS (SELECT min(t) + {_FIRST} - 1 AS first FROM nation_covariates),
  fits AS (SELECT DISTINCT first + (t - first) // {_EVERY} * {_EVERY} AS f FROM nation_covariates, lo WHERE t >= first),
  good AS (SELECT *, {group} AS g FROM nation_covariates WHERE y IS NOT NULL AND tmin IS NOT NULL),
  profiles AS MATERIALIZED (SELECT g, f, t % 12 AS m, avg(y) AS s FROM good JOIN fits ON t <= f GROUP BY ALL),
  slopes AS MATERIALIZED (SELECT g, f, avg(y) AS mean, avg(tmin) AS centre, covar_pop(y, tmin) / var_pop(tmin) AS b FROM good JOIN fits ON t <= f GROUP BY ALL),
  due AS (SELECT GID_2, {group} AS g, "Date", t, Cases, h, t - h AS o, first + (t - h - first) // {_EVERY} * {_EVERY} AS f
    FROM nation_covariates, lo, (SELECT unnest([1, 3, 6]) AS h) WHERE t - h >= first),
  origins AS (SELECT DISTINCT GID_2, g, o, f FROM due),
  starts AS (SELECT GID_2, min(t) AS t0 FROM nation_covariates GROUP BY 1),
  levels AS (SELECT GID_2, o, sum((y - coalesce(s, mean)) * CASE WHEN t = t0 THEN 0.7 ** (o - t) ELSE 0.3 * 0.7 ** (o - t) END) AS level
    FROM origins JOIN starts USING (GID_2) JOIN nation_covariates n USING (GID_2) JOIN slopes USING (g, f)
      LEFT JOIN profiles p ON p.g = origins.g AND p.f = origins.f AND p.m = n.t % 12 WHERE n.t <= o GROUP BY ALL)
  SELECT GID_2, d."Date", CAST(h AS INTEGER) AS horizon, CAST(d.Cases AS DOUBLE) AS Cases,
    round(greatest(exp(level + coalesce(s, mean) + b * (x.tmin - centre)) - 1, 0), 4) AS prediction
  FROM due d JOIN levels USING (GID_2, o) JOIN slopes USING (g, f) JOIN nation_covariates x ON x.GID_2 = d.GID_2 AND x.t = d.o
    LEFT JOIN profiles p ON p.g = d.g AND p.f = d.f AND p.m = d.t % 12"""


def _smoothing(level):
    def run(spark, d):
        out = harness.backtest_groups(nation_covariates(spark, d), harness.seasonal_smoothing(0.3), horizons=(1, 3, 6), level=level, covariates=["tmin"],
                                      retrain=_EVERY, min_train=_FIRST)
        return out.withColumn(PREDICTION, F.round(PREDICTION, 4))

    return run


for _level, (_name, _group) in enumerate((("country", "'all'"), ("state", "GID_1"), ("region", "GID_2"))):
    cte(f"smoothing_{_name}", _sql_smoothing(_group), "nation_covariates")
    query(f"smoothing_backtest_by_{_name}", f"SELECT * FROM smoothing_{_name}", f"smoothing_{_name}")(_smoothing(_level))


@query("boosted_lag_forecast")
def _(spark, d):
    out = boosting.boosted_lags(nation_covariates(spark, d), ["tmin", "prec"], horizons=(1, 3, 6, 12), train_end="1999-12-31", start_date="2000-01-31")
    return out.withColumn(PREDICTION, F.round(PREDICTION, 5))


@query("residual_regression_pinball")
def _(spark, d):
    forecast = access.pick(views.baseline_forecast(spark, d), horizon=1)
    return residual_regression.residual_regression(
        _known(spark, d, forecast), region_embeddings(spark, d), window=24)


@query("residual_regression_ridge")
def _(spark, d):
    forecast = access.pick(views.baseline_forecast(spark, d), quantile=0.5)
    return residual_regression.residual_regression(
        _known(spark, d, forecast), region_embeddings(spark, d), method="ridge", window=24, horizons=views.HORIZONS)


# the regression's errors, with the first two features of each region
cte("median_errors", """
  SELECT f.GID_2, f."Date", f.horizon, CAST(year(f."Date") * 12 + month(f."Date") AS INTEGER) AS t, f.prediction, f.Cases,
    ln(1 + f.prediction) AS base, ln(1 + f.Cases) - ln(1 + f.prediction) AS e,
    CAST(v.embedding[1] AS DOUBLE) AS x1, CAST(v.embedding[2] AS DOUBLE) AS x2
  FROM baseline_forecast f JOIN embeddings v ON v.vec_id = split_part(split_part(f.GID_2, '.', 3), '_', 1)::BIGINT
  WHERE f.quantile = 0.5""", "baseline_forecast")
_RIDGE = [[f"m{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_RIDGE_COLS = [[[f"c{r}" if c == k else _RIDGE[r][c] for c in range(3)] for r in range(3)] for k in range(3)]


def sql_ridge(rows: str, keys: str) -> str:
    """SQL of ridge fits with two features, per key and target month, on the 24 months up to the forecast's origin."""
    sums = {"m00": "count(e)", "m01": "sum(x1)", "m02": "sum(x2)", "m11": "sum(x1 * x1)", "m12": "sum(x1 * x2)", "m22": "sum(x2 * x2)",
            "c0": "sum(e)", "c1": "sum(x1 * e)", "c2": "sum(x2 * e)"}
    more = {"m00": " + 1e-9", "m11": " + 1", "m22": " + 1"}
    return f"""
  SELECT {keys}, t, {", ".join(f"{_det(_RIDGE_COLS[k])} / {_det(_RIDGE)} AS b{k}" for k in range(3))} FROM (
    SELECT {keys}, d.t, {", ".join(f"sum({c}){more.get(c, '')} AS {c}" for c in sums)}
    FROM (SELECT DISTINCT t FROM {rows}) d JOIN (
      SELECT {keys}, t AS u, {", ".join(f"{v} AS {c}" for c, v in sums.items())} FROM {rows} WHERE e IS NOT NULL GROUP BY ALL) s
    ON u BETWEEN d.t - horizon - 23 AND d.t - horizon GROUP BY ALL)"""


def _two_features(spark, d):
    return region_embeddings(spark, d).withColumn("embedding", F.slice("embedding", 1, 2))


cte("ridge_fits", sql_ridge("median_errors", "horizon"), "median_errors")


@query("residual_regression_two_features", """
  SELECT GID_2, "Date", horizon, CAST(0.5 AS DOUBLE) AS quantile, Cases,
         CASE WHEN base IS NOT NULL THEN round(greatest(exp(base + coalesce(b0 + b1 * x1 + b2 * x2, 0)) - 1, 0), 3) END AS prediction
  FROM median_errors LEFT JOIN ridge_fits USING (horizon, t)""", "median_errors", "ridge_fits")
def _(spark, d):
    forecast = access.pick(views.baseline_forecast(spark, d), quantile=0.5)
    out = residual_regression.residual_regression(
        _known(spark, d, forecast), _two_features(spark, d), method="ridge", window=24, horizons=views.HORIZONS)
    return out.withColumns({PREDICTION: F.round(PREDICTION, 3), CASES: F.col(CASES).cast("double")})


@query("ridge_bias_two_features", """
  SELECT GID_2, round(my + b1 * (x1 - m1) + b2 * (x2 - m2), 6) AS bias
  FROM (SELECT DISTINCT GID_2, x1, x2 FROM median_errors WHERE horizon = 1 AND prediction IS NOT NULL), (
    SELECT *, (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) AS b1, (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (
      SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) * var_pop(x1) + 2 AS s11, count(*) * var_pop(x2) + 2 AS s22,
             count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS r1, count(*) * covar_pop(x2, y) AS r2
      FROM (SELECT x1, x2, Cases - prediction AS y FROM median_errors WHERE horizon = 1 AND prediction IS NOT NULL)))""", "median_errors")
def _(spark, d):
    forecast = access.pick(views.baseline_forecast(spark, d), quantile=0.5, horizon=1).dropna(subset=[PREDICTION])
    model = residual_regression.RidgeBias(_two_features(spark, d), alpha=2.0).fit(_known(spark, d, forecast))
    return model.biases().select(GID_2, F.round("bias", 6).alias("bias"))


@query("principal_component_lengths", """
  SELECT GID_2, "Date", round((tmin - avg(tmin) OVER ()) ** 2 + (tmax - avg(tmax) OVER ()) ** 2 + (prec - avg(prec) OVER ()) ** 2, 4) AS length
  FROM climate""", "climate")
def _(spark, d):
    # all components together keep each row's distance from the mean, whatever their signs
    out = features.pca_transform(views.climate(spark, d), ["tmin", "tmax", "prec"], keep=3)
    return out.select(GID_2, DATE, F.round(sum(F.col(f"PC{i}") ** 2 for i in (1, 2, 3)), 4).alias("length"))


@query("ridge_bias")
def _(spark, d):
    forecast = access.pick(views.baseline_forecast(spark, d), quantile=0.5, horizon=1).dropna(subset=[PREDICTION])
    model = residual_regression.RidgeBias(region_embeddings(spark, d), alpha=2.0)
    known = _known(spark, d, forecast)
    return model.fit(known).apply(known)


def _uniform(salt):
    text = f"concat_ws(':', GID_2, rep, feature, 42, {salt})"
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("noise_control_features", f"""
  SELECT GID_2, CAST(rep AS INTEGER) AS rep, CAST(feature AS INTEGER) AS feature,
         round(sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)}), 8) AS value
  FROM (SELECT GID_2, rep, unnest(range(n)) AS feature FROM (
    SELECT GID_2, n, unnest(range(100)) AS rep FROM (
      SELECT format('TST.{{}}.{{}}_1', s_suppkey % 25, s_suppkey) AS GID_2, len(embedding) AS n
      FROM supplier JOIN embeddings ON s_suppkey = vec_id)))""")
def _(spark, d):
    noise = residual_regression.noise_embeddings(region_embeddings(spark, d))
    return noise.select(GID_2, "rep", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.round("value", 8))


@query("principal_components")
def _(spark, d):
    clean = features.sanitise_covariates(
        views.covariate_panel(spark, d).withColumn(FUTURE, F.lit(False)), ["tmin", "tmax", "prec", "SPI6"], across_regions=True)
    return features.pca_transform(clean, ["tmin", "tmax", "prec", "SPI6"], keep=3)


@query("embedding_coverage", """
  SELECT DISTINCT GID_2 FROM supplier_panel WHERE split_part(split_part(GID_2, '.', 3), '_', 1)::BIGINT NOT IN (SELECT vec_id FROM embeddings WHERE label < 2)""",
       "supplier_panel")
def _(spark, d):
    from epipanel.operators.covariates import regions_without

    vectors = views.table(spark, d, "embeddings").where("label < 2").select(
        F.format_string("TST.%d.%d_1", F.col("vec_id") % 25, F.col("vec_id")).alias(GID_2))
    return regions_without(views.supplier_panel(spark, d), vectors)


@query("embeddings_on_forecasts", """
  SELECT f.GID_2, f."Date", f.horizon, f.quantile, len(e.embedding) AS size, CAST(e.embedding[1] AS FLOAT) AS first,
    round(list_sum(CAST(e.embedding AS DOUBLE[])), 4) AS total
  FROM baseline_forecast f JOIN embeddings e ON e.vec_id = split_part(split_part(f.GID_2, '.', 3), '_', 1)::BIGINT""",
       "baseline_forecast")
def _(spark, d):
    from epipanel.operators.covariates import attach_embeddings

    known = _known(spark, d, views.baseline_forecast(spark, d))
    out = attach_embeddings(known, region_embeddings(spark, d), check=False)
    return out.select(GID_2, DATE, HORIZON, QUANTILE, F.size("embedding").cast("long").alias("size"),
                      F.col("embedding")[0].alias("first"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double")), 4).alias("total"))


cte("noise_features", f"""
  SELECT GID_2, CAST(rep AS INTEGER) AS rep, max(v) FILTER (WHERE feature = 0) AS x1, max(v) FILTER (WHERE feature = 1) AS x2 FROM (
    SELECT *, sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)}) AS v FROM (
      SELECT DISTINCT GID_2, unnest(range(100)) AS rep, feature FROM median_errors, (SELECT unnest([0, 1]) AS feature)))
  GROUP BY 1, 2 UNION ALL SELECT DISTINCT GID_2, -1, x1, x2 FROM median_errors""", "median_errors")
cte("noise_errors", """
  SELECT GID_2, "Date", horizon, t, Cases, base, e, rep, n.x1, n.x2 FROM (SELECT * EXCLUDE (x1, x2) FROM median_errors WHERE horizon = 6) JOIN noise_features n USING (GID_2)""",
    "median_errors", "noise_features")
cte("noise_fits", sql_ridge("noise_errors", "rep, horizon"), "noise_errors")
cte("noise_scores", """
  SELECT rep, CAST(horizon AS INTEGER) AS horizon, avg(CASE WHEN base IS NOT NULL THEN abs(Cases - greatest(exp(base + coalesce(b0 + b1 * x1 + b2 * x2, 0)) - 1, 0)) END) AS WIS
  FROM noise_errors LEFT JOIN noise_fits USING (rep, horizon, t) GROUP BY ALL""", "noise_errors", "noise_fits")


def _noise(spark, d):
    forecast = access.pick(views.baseline_forecast(spark, d), quantile=0.5, horizon=6)
    return residual_regression.noise_scores(_known(spark, d, forecast), _two_features(spark, d), method="ridge", window=24, horizons=(6,))


@query("noise_control_scores", "SELECT rep, horizon, round(WIS, 5) AS WIS FROM noise_scores", "noise_scores")
def _(spark, d):
    return _noise(spark, d).withColumn("WIS", F.round("WIS", 5))


@query("noise_control", """
  SELECT horizon, round(max(WIS) FILTER (WHERE rep < 0), 5) AS real_wis, round(avg(WIS) FILTER (WHERE rep >= 0), 5) AS noise_wis,
    round(min(WIS) FILTER (WHERE rep >= 0), 5) AS best_noise_wis,
    CAST(1 + count(*) FILTER (WHERE rep >= 0 AND round(WIS, 9) < (SELECT round(WIS, 9) FROM noise_scores WHERE rep < 0)) AS INTEGER) AS place,
    CAST(count(*) FILTER (WHERE rep >= 0) AS INTEGER) AS repetitions FROM noise_scores GROUP BY 1""", "noise_scores")
def _(spark, d):
    out = residual_regression.noise_control(_noise(spark, d))
    return out.withColumns({c: F.round(c, 5) for c in ("real_wis", "noise_wis", "best_noise_wis")})
