"""Views of the sample tables as line lists, panels, covariates and forecasts.

The rows keep their number: every view reads its whole tables. Each view has
its SQL twin, registered as a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epipanel.operators import panel
from epipanel.plans.catalog import cte
from epipanel.schema import CASES, DATE, GID_1, GID_2, QUANTILE_LEVELS, with_period
from epipanel.sources.stage import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def region_dim(spark: SparkSession, d: str) -> DataFrame:
    """Nations as municipalities, their regions as states."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lit("TST").alias("GID_0"), F.col("r_name").alias(GID_1), F.col("r_name").alias("NAME_1"),
        F.col("n_name").alias(GID_2), F.col("n_name").alias("NAME_2"),
        F.concat(F.lit("TST."), F.col("n_nationkey")).alias("HASC_2"),
    )


cte("region_dim", """
  SELECT 'TST' AS GID_0, r_name AS GID_1, r_name AS NAME_1, n_name AS GID_2, n_name AS NAME_2,
         'TST.' || n_nationkey AS HASC_2
  FROM nation JOIN region ON n_regionkey = r_regionkey""")


def line_list(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases: one row per order, dated, in the customer's nation."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.to_date("o_orderdate").alias(DATE), F.col("n_name").alias(GID_2),
                F.col("r_name").alias(GID_1), F.col("o_orderstatus").alias("Status"))
    )


cte("line_list", """
  SELECT CAST(o_orderdate AS DATE) AS "Date", n_name AS GID_2, r_name AS GID_1, o_orderstatus AS Status
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


def _supplier_gid(key: str):
    return F.format_string("TST.%d.%d_1", F.col(key) % 25, F.col(key))


_SUPPLIER_GID = "'TST.' || (l_suppkey % 25) || '.' || l_suppkey || '_1'"


def counted_list(spark: SparkSession, d: str) -> DataFrame:
    """Line items as counted cases of many regions, one region per supplier."""
    return table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias(DATE), _supplier_gid("l_suppkey").alias(GID_2),
        F.format_string("TST.%d_1", F.col("l_suppkey") % 25).alias(GID_1),
        F.col("l_quantity").cast("long").alias(CASES), F.col("l_linestatus").alias("Status"),
    )


cte("counted_list", f"""
  SELECT CAST(l_shipdate AS DATE) AS "Date", {_SUPPLIER_GID} AS GID_2,
         'TST.' || (l_suppkey % 25) || '_1' AS GID_1, CAST(l_quantity AS BIGINT) AS Cases,
         l_linestatus AS Status
  FROM lineitem""")


def event_list(spark: SparkSession, d: str) -> DataFrame:
    """Events as daily cases, one region per user."""
    return table(spark, d, "events").select(
        F.to_date("ts").alias(DATE), F.col("user_id").cast("string").alias(GID_2),
        (F.col("user_id") % 10).cast("string").alias(GID_1), F.col("event_type").alias("Status"),
    )


cte("event_list", """
  SELECT CAST(ts AS DATE) AS "Date", CAST(user_id AS VARCHAR) AS GID_2,
         CAST(user_id % 10 AS VARCHAR) AS GID_1, event_type AS Status
  FROM events""")


def sql_grid(source: str, amount: str, period: str, step: str, extra: str = "") -> str:
    """SQL of a dense panel over ``source``: every region in every period, zero-filled."""
    ends = "last_day(CAST(t AS DATE))" if step == "1 month" else "CAST(t AS DATE)"
    lo = "date_trunc('month', lo)" if step == "1 month" else "lo"
    return f"""
  SELECT g.GID_2, p."Date", g.GID_1, CAST(COALESCE(c.Cases, 0) AS BIGINT) AS Cases
  FROM (SELECT GID_2, arg_min(GID_1, ("Date", GID_1)) AS GID_1 FROM {source} {extra} GROUP BY GID_2) g
  CROSS JOIN (SELECT {ends} AS "Date" FROM
     (SELECT unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {step})) AS t
      FROM (SELECT min({period}) AS lo, max({period}) AS hi FROM {source} {extra}))) p
  LEFT JOIN (SELECT GID_2, {period} AS "Date", {amount} AS Cases FROM {source} {extra} GROUP BY 1, 2) c
    ON c.GID_2 = g.GID_2 AND c."Date" = p."Date" """


# Last day of the week that holds a date (isodow: Monday 1 ... Sunday 7).
WEEK_SUN = """CAST("Date" + CAST(7 - isodow("Date") AS INTEGER) AS DATE)"""
WEEK_SAT = """CAST("Date" + CAST((13 - isodow("Date")) % 7 AS INTEGER) AS DATE)"""

cte("nation_panel", sql_grid("line_list", "count(*)", 'last_day("Date")', "1 month"), "line_list")
cte("supplier_panel", sql_grid("counted_list", "sum(Cases)", 'last_day("Date")', "1 month"), "counted_list")


def nation_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.cases_per_month(line_list(spark, d))


def supplier_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.cases_per_month(counted_list(spark, d).drop("Status"))


def supplier_future(spark: SparkSession, d: str, n: int = 12) -> DataFrame:
    """Supplier panel with ``n`` months to come."""
    return panel.add_future(supplier_panel(spark, d), n)


cte("supplier_future", """
  SELECT GID_2, "Date", GID_1, Cases, false AS future FROM supplier_panel
  UNION ALL
  SELECT GID_2, last_day(CAST(date_trunc('month', "Date") + to_months(CAST(n AS INTEGER)) AS DATE)), GID_1, NULL, true
  FROM supplier_panel, range(1, 13) r(n) WHERE "Date" = (SELECT max("Date") FROM supplier_panel)""",
    "supplier_panel")


def climate(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means of discount, tax and price as climate of each region."""
    return with_period(
        table(spark, d, "lineitem")
        .groupBy(_supplier_gid("l_suppkey").alias(GID_2), F.last_day(F.to_date("l_shipdate")).alias(DATE))
        .agg((F.avg("l_discount") * 100).alias("tmin"), (F.avg("l_tax") * 100).alias("tmax"),
             (F.avg("l_extendedprice") / 1013).alias("prec")),
        "M",
    )


cte("climate", f"""
  SELECT {_SUPPLIER_GID} AS GID_2, last_day(CAST(l_shipdate AS DATE)) AS "Date",
         avg(l_discount) * 100 AS tmin, avg(l_tax) * 100 AS tmax, avg(l_extendedprice) / 1013 AS prec
  FROM lineitem GROUP BY 1, 2""")


def drought(spark: SparkSession, d: str) -> DataFrame:
    """Monthly index of each region, from quantities."""
    return with_period(
        table(spark, d, "lineitem")
        .groupBy(_supplier_gid("l_suppkey").alias(GID_2), F.last_day(F.to_date("l_shipdate")).alias(DATE))
        .agg(((F.avg("l_quantity") - 25) / 10).alias("mean")),
        "M",
    )


cte("drought", f"""
  SELECT {_SUPPLIER_GID} AS GID_2, last_day(CAST(l_shipdate AS DATE)) AS "Date",
         (avg(l_quantity) - 25) / 10 AS mean
  FROM lineitem GROUP BY 1, 2""")


def ocean_index(spark: SparkSession, d: str) -> DataFrame:
    """One monthly index for all regions, from order prices."""
    return with_period(
        table(spark, d, "orders")
        .groupBy(F.last_day(F.to_date("o_orderdate")).alias(DATE))
        .agg((F.avg("o_totalprice") / 10000).alias("TotalONI"),
             ((F.avg("o_totalprice") - 250000) / 10000).alias("AnomONI")),
        "M",
    )


cte("ocean_index", """
  SELECT last_day(CAST(o_orderdate AS DATE)) AS "Date", avg(o_totalprice) / 10000 AS TotalONI,
         (avg(o_totalprice) - 250000) / 10000 AS AnomONI
  FROM orders GROUP BY 1""")


def population(spark: SparkSession, d: str) -> DataFrame:
    """Yearly inhabitants of each region, constrained and unconstrained estimates."""
    return (
        table(spark, d, "lineitem")
        .groupBy(_supplier_gid("l_suppkey").alias(GID_2), F.year(F.to_date("l_shipdate")).alias("year"))
        .agg(F.sum(F.round(F.col("l_extendedprice"))).alias("pop_count"),
             F.sum(F.round(F.col("l_extendedprice") * 2)).alias("pop_estimate_unconstrained"),
             F.sum(F.round(F.col("l_extendedprice") * 3)).alias("pop_estimate_constrained"))
    )


cte("population", f"""
  SELECT {_SUPPLIER_GID} AS GID_2, year(l_shipdate)::INTEGER AS year,
         sum(round(l_extendedprice)) AS pop_count,
         sum(round(l_extendedprice * 2)) AS pop_estimate_unconstrained,
         sum(round(l_extendedprice * 3)) AS pop_estimate_constrained
  FROM lineitem GROUP BY 1, 2""")


def climate_stats(spark: SparkSession, d: str) -> DataFrame:
    """Climate in long form: one row per region, date and metric."""
    wide = climate(spark, d)
    return wide.unpivot([GID_2, DATE], ["tmin", "tmax", "prec"], "metric", "mean")


cte("climate_stats", """
  SELECT GID_2, "Date", 'tmin' AS metric, tmin AS mean FROM climate
  UNION ALL SELECT GID_2, "Date", 'tmax', tmax FROM climate
  UNION ALL SELECT GID_2, "Date", 'prec', prec FROM climate""", "climate")


def population_stats(spark: SparkSession, d: str) -> DataFrame:
    wide = population(spark, d)
    return wide.unpivot([GID_2, "year"], [c for c in wide.columns if c not in (GID_2, "year")], "metric", "sum")


def covariate_panel(spark: SparkSession, d: str) -> DataFrame:
    """Supplier panel with climate, drought, ocean index, population and incidence."""
    from epipanel.operators.covariates import covariate_panel as join_all
    from epipanel.operators.covariates import standard_sources

    registry = standard_sources(climate_stats(spark, d), drought(spark, d), ocean_index(spark, d),
                                population_stats(spark, d))
    return join_all(supplier_panel(spark, d), registry)


cte("covariate_panel", """
  SELECT p.*, c.tmin, c.tmax, c.prec, d.mean AS SPI6, o.TotalONI, o.AnomONI, n.pop_count,
         100000.0 * p.Cases / nullif(n.pop_count, 0) AS DIR
  FROM supplier_panel p
  LEFT JOIN climate c ON c.GID_2 = p.GID_2 AND c."Date" = p."Date"
  LEFT JOIN drought d ON d.GID_2 = p.GID_2 AND d."Date" = p."Date"
  LEFT JOIN ocean_index o ON o."Date" = p."Date"
  LEFT JOIN population n ON n.GID_2 = p.GID_2 AND n.year = year(p."Date")""",
    "supplier_panel", "climate", "drought", "ocean_index", "population")


def baseline_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Baseline quantile forecasts of the supplier panel, at the horizons that are scored."""
    from epipanel.operators.baseline import baseline

    return baseline(supplier_panel(spark, d), horizon=HORIZONS)


HORIZONS = [1, 3, 6, 12]
_LEVELS = f"CAST({list(QUANTILE_LEVELS)} AS DOUBLE[])"
# Of 1000 evenly spaced draws the levels lie between these (position / 999) pairs.
_PLACES = [(q, int(q * 999 + 1e-9), q * 999 - int(q * 999 + 1e-9)) for q in QUANTILE_LEVELS]
_DRAWN = sorted({j for _, low, _ in _PLACES for j in (low, low + 1)})


def sql_baseline(source: str, horizons: str, pooled: str, shift: str) -> str:
    """SQL of baseline forecasts without future rows."""
    at = {j: f"s[{i + 1}]" for i, j in enumerate(_DRAWN)}
    median = f"(({at[499]} + {at[500]}) / 2)"

    def draw(j: int) -> str:
        return f"greatest(lvl + {at[j]} + {shift.format(median=median)}, 0)"

    values = ", ".join(f"{draw(low)} + ({draw(low + 1)} - {draw(low)}) * {part!r}" for _, low, part in _PLACES)
    marks = ", ".join(repr(j / 999) for j in _DRAWN)
    return f"""
  SELECT GID_2, "Date", horizon, unnest({_LEVELS}) AS quantile, unnest([{values}]) AS prediction,
         c AS Cases, false AS future
  FROM (SELECT t.GID_2, t."Date", t.k, t.c, h.h AS horizon, any_value(l.c) AS lvl,
               quantile_cont({pooled}, [{marks}]) AS s
        FROM {source} t CROSS JOIN (SELECT unnest({horizons}) AS h) h CROSS JOIN (VALUES (1), (-1)) g(sgn)
        JOIN {source} d ON d.GID_2 = t.GID_2 AND d.k >= 1 AND d.k <= t.k - h.h - 1
        JOIN {source} l ON l.GID_2 = t.GID_2 AND l.k = t.k - h.h
        WHERE t.k >= 2 + h.h GROUP BY ALL) z
  UNION ALL
  SELECT GID_2, "Date", h, CAST(0.5 AS DOUBLE), NULL, c, false
  FROM {source}, (SELECT unnest({horizons}) AS h) WHERE k < 3"""


cte("supplier_rows", """
  SELECT GID_2, "Date", c, k, c - lag(c) OVER (PARTITION BY GID_2 ORDER BY k) AS d
  FROM (SELECT GID_2, "Date", CAST(Cases AS DOUBLE) AS c,
               CAST(row_number() OVER (PARTITION BY GID_2 ORDER BY "Date") - 1 AS INTEGER) AS k
        FROM supplier_panel)""", "supplier_panel")
cte("baseline_forecast", sql_baseline("supplier_rows", str(HORIZONS), "g.sgn * d.d", "(-{median})"), "supplier_rows")


def model_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Three models: the baseline and two fixed scalings of it."""
    from epipanel.operators.ensemble import stack_models

    return stack_models(forecasts_by_model(spark, d))


def forecasts_by_model(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    base = stage(baseline_forecast(spark, d))
    p = F.col("prediction")
    return {
        "base": base,
        "high": base.withColumn("prediction", p * 1.25 + 1),
        "low": base.withColumn("prediction", p * 0.7),
    }


cte("model_forecasts", """
  SELECT *, 'base' AS model FROM baseline_forecast
  UNION ALL SELECT * REPLACE (prediction * 1.25 + 1 AS prediction), 'high' FROM baseline_forecast
  UNION ALL SELECT * REPLACE (prediction * 0.7 AS prediction), 'low' FROM baseline_forecast""",
    "baseline_forecast")


# Simple forecasts beside the baseline: the point forecast from the last value known and those before it, and how wide it spreads.
_SIMPLE = {
    "naive": ("avg", 0, 2.0), "seasonal": (None, 0, 2.0), "mean3": ("avg", 2, 1.5), "mean12": ("avg", 11, 3.0), "peak6": ("max", 5, 1.0)}
SIX_MODELS = ["base", *_SIMPLE]


def six_forecasts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Six different models of the supplier panel with the same rows: the baseline and five simple ones."""
    w = Window.partitionBy(GID_2).orderBy(DATE)
    rows = supplier_panel(spark, d).select(GID_2, DATE, F.col(CASES).cast("double").alias("_c"))
    rows = rows.withColumns({"_k": F.row_number().over(w) - 1, "_d": F.abs(F.col("_c") - F.lag("_c").over(w))})
    cells = []
    for h in HORIZONS:
        past = w.rowsBetween(Window.unboundedPreceding, -h)
        points = [F.lag("_c", 12).over(w) if how is None else getattr(F, how)("_c").over(w.rowsBetween(-h - back, -h))
                  for how, back, _ in _SIMPLE.values()]
        cells.append(F.struct(F.lit(h).alias("h"), F.avg("_d").over(past).alias("s"), F.array(*points).alias("p")))
    # every model has a row from here on
    whole = rows.withColumn("_x", F.array(*cells)).where(F.col("_k") >= 2 + max(HORIZONS))
    # stored before the levels multiply it
    points = stage(whole.select(GID_2, DATE, F.col("_c").alias(CASES), F.explode("_x").alias("_x")))
    long = points.withColumn("quantile", F.explode(F.array(*map(F.lit, QUANTILE_LEVELS))))
    dates = points.select(GID_2, DATE).distinct()
    out = {"base": stage(baseline_forecast(spark, d).join(dates, [GID_2, DATE], "left_semi").drop("future"))}
    for i, (name, (_, _, width)) in enumerate(_SIMPLE.items()):
        value = F.greatest(F.col("_x.p")[i] + F.col("_x.s") * (2 * F.col("quantile") - 1) * width, F.lit(0.0))
        out[name] = long.select(GID_2, DATE, F.col("_x.h").alias("horizon"), "quantile", value.alias("prediction"), CASES)
    return out


def _sql_simple() -> str:
    parts = []
    for h in HORIZONS:
        values = []
        for name, (how, back, width) in _SIMPLE.items():
            point = "lag(c, 12) OVER w" if how is None else f"{how}(c) OVER (PARTITION BY GID_2 ORDER BY k ROWS BETWEEN {h + back} PRECEDING AND {h} PRECEDING)"
            values.append(f"{point} AS {name}")
        parts.append(f"""SELECT GID_2, "Date", k, c, {h} AS horizon, {', '.join(values)},
            avg(abs(d)) OVER (PARTITION BY GID_2 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING) AS s
            FROM supplier_rows WINDOW w AS (PARTITION BY GID_2 ORDER BY k)""")
    preds = ", ".join(f"greatest({name} + s * (2 * q - 1) * {width!r}, 0) AS p{i + 1}" for i, (name, (_, _, width)) in enumerate(_SIMPLE.items()))
    return f"""
  SELECT b.horizon, b.GID_2, b."Date", b.quantile AS q, b.Cases AS y, b.prediction AS p0, {', '.join(f'p{i + 1}' for i in range(len(_SIMPLE)))}
  FROM baseline_forecast b JOIN (
    SELECT *, {preds} FROM (SELECT *, unnest({_LEVELS}) AS q FROM ({' UNION ALL '.join(parts)}) WHERE k >= {2 + max(HORIZONS)})) x
  ON b.horizon = x.horizon AND b.GID_2 = x.GID_2 AND b."Date" = x."Date" AND b.quantile = x.q"""


cte("six_wide", _sql_simple(), "baseline_forecast", "supplier_rows")


def forecast_samples(spark: SparkSession, d: str) -> DataFrame:
    """Line items as draws: their prices per supplier and month."""
    return table(spark, d, "lineitem").select(
        _supplier_gid("l_suppkey").alias(GID_2), F.last_day(F.to_date("l_shipdate")).alias(DATE),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"),
        (F.col("l_extendedprice") / 1013).alias("prediction"),
        (F.month("l_shipdate") * 10.0 + F.col("l_suppkey") % 7).alias(CASES))


cte("forecast_samples", f"""
  SELECT {_SUPPLIER_GID} AS GID_2, last_day(CAST(l_shipdate AS DATE)) AS "Date",
         l_orderkey * 10 + l_linenumber AS sample, l_extendedprice / 1013 AS prediction,
         CAST(month(l_shipdate) * 10.0 + l_suppkey % 7 AS DOUBLE) AS Cases
  FROM lineitem""")
