"""Reading and writing: tables over the sample data written, read back and compared."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from epipanel.functions.scalars import interval_score
from epipanel.operators import access, ensemble, models
from epipanel.plans import views
from epipanel.plans.catalog import query
from epipanel.schema import CASES, DATE, GID_1, GID_2, HORIZON, PREDICTION, QUANTILE, SAMPLE
from epipanel.sources import readers, store, tables
from epipanel.sources.stage import stage_folder


def _folder(spark) -> str:
    return f"{stage_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"


@query("table_written_and_read", 'SELECT GID_2, "Date", GID_1, Cases FROM nation_panel', "nation_panel")
def _(spark, d):
    path = f"{_folder(spark)}/panel"
    tables.write_table(views.nation_panel(spark, d), path)
    return tables.read_table(spark, path)  # the suffix is found


@query("table_replaced_by_itself", 'SELECT GID_2, "Date", GID_1, 2 * Cases AS Cases FROM supplier_panel', "supplier_panel")
def _(spark, d):
    path = tables.write_table(views.supplier_panel(spark, d), f"{_folder(spark)}/panel")
    tables.write_table(tables.read_table(spark, path).withColumn(CASES, F.col(CASES) * 2), path)
    return tables.read_table(spark, path)


@query("table_written_by_year", """
  SELECT GID_2, "Date", GID_1, Cases, CAST(year("Date") AS INTEGER) AS year FROM supplier_panel""", "supplier_panel")
def _(spark, d):
    return tables.read_table(spark, tables.write_by_year(views.supplier_panel(spark, d), f"{_folder(spark)}/panel"))


@query("table_appended", 'SELECT GID_2, "Date", GID_1, Cases FROM supplier_panel', "supplier_panel")
def _(spark, d):
    panel, path = views.supplier_panel(spark, d), f"{_folder(spark)}/panel"
    early = F.col(DATE) < "1998-01-01"
    tables.append_table(panel.where(early), path)
    # other order of columns, ids checked against those there are
    again = panel.where(~early).select(CASES, GID_1, DATE, GID_2)
    return tables.read_table(spark, tables.append_table(again, path, regions=panel.select(GID_2).distinct()))


@query("unknown_regions", """
  SELECT DISTINCT GID_2 FROM supplier_panel WHERE split_part(GID_2, '.', 2) NOT IN
    (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 3)""", "supplier_panel")
def _(spark, d):
    panel = views.supplier_panel(spark, d)
    states = views.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("state"))
    known = panel.select(GID_2, F.split(GID_2, r"\.")[1].alias("state")).join(states, "state", "left_semi")
    return tables.unknown_regions(panel, known)


@query("line_list_from_csv", 'SELECT "Date", GID_2, GID_1 FROM line_list', "line_list")
def _(spark, d):
    rows = views.line_list(spark, d).select(DATE, GID_2, GID_1)
    return readers.read_line_list(spark, tables.write_csv(rows, f"{_folder(spark)}/cases.csv"))


@query("table_from_csv", """
  SELECT GID_2, "Date", CAST(Cases AS INTEGER) AS Cases FROM supplier_panel""", "supplier_panel")
def _(spark, d):
    path = f"{_folder(spark)}/panel"
    tables.write_csv(views.supplier_panel(spark, d).select(GID_2, DATE, CASES), path + ".csv")
    return tables.read_table(spark, path)


@query("forecast_samples_from_csv", """
  SELECT GID_2, "Date", sample, round(prediction, 6) AS prediction, Cases FROM forecast_samples""", "forecast_samples")
def _(spark, d):
    drawn = views.forecast_samples(spark, d).select(GID_2, DATE, SAMPLE, PREDICTION, CASES)
    read = readers.read_forecast_samples(spark, tables.write_csv(drawn, f"{_folder(spark)}/samples.csv"))
    return read.withColumn(PREDICTION, F.round(PREDICTION, 6))


@query("weekly_feed_from_json", """
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS "Date", CAST(o_custkey % 100 AS VARCHAR) AS code, count(*) AS Cases
  FROM orders GROUP BY 1, 2""")
def _(spark, d):
    feed = views.table(spark, d, "orders").groupBy(
        (F.unix_date(F.to_date(F.date_trunc("week", "o_orderdate"))).cast("long") * 86400000).alias("data_iniSE"),
        (F.col("o_custkey") % 100).alias("Localidade_id")).agg(F.count("*").alias("casos"))
    path = f"{_folder(spark)}/feed.json"
    feed.write.json(path)
    return readers.read_weekly_feed(spark, path)


@query("gridded_values_by_metric", """
  SELECT 'prec' AS metric, last_day(CAST(l_shipdate AS DATE)) AS "Date", CAST(l_suppkey % 100 + 0.5 AS DOUBLE) AS x,
         CAST(l_suppkey // 100 + 0.5 AS DOUBLE) AS y, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem GROUP BY ALL""")
def _(spark, d):
    cells = (
        views.table(spark, d, "lineitem")
        .groupBy(F.last_day(F.to_date("l_shipdate")).alias(DATE), (F.col("l_suppkey") % 100 + 0.5).cast("double").alias("x"),
                 (F.floor(F.col("l_suppkey") / 100) + 0.5).cast("double").alias("y"))
        .agg(F.sum("l_quantity").alias("prec"), F.avg("l_tax").alias("tmax"))
        .unpivot([DATE, "x", "y"], ["prec", "tmax"], "metric", "value"))
    path = readers.write_gridded(cells.repartition(DATE), f"{_folder(spark)}/cells")
    return readers.read_gridded(spark, path, "prec").select("metric", DATE, "x", "y", "value")


@query("session_tables", """
  SELECT 'cases' AS name, (SELECT count(*) FROM line_list) AS n
  UNION ALL SELECT 'events', (SELECT count(*) FROM events)
  UNION ALL SELECT 'missing', 0""", "line_list")
def _(spark, d):
    own = spark.newSession()
    for name, df in (("cases", views.line_list(own, d)), ("events", views.table(own, d, "events")),
                     ("__internal", views.table(own, d, "nation"))):
        tables.as_view(df, name)
    names = [*tables.user_tables(own), "missing"]
    return reduce(lambda a, b: a.unionByName(b), [
        spark.range(1).select(F.lit(n).alias("name"), F.lit(tables.row_count(own, n)).cast("long").alias("n")) for n in names])


@query("first_rows", """
  SELECT GID_2, "Date", Cases FROM supplier_panel ORDER BY Cases DESC, GID_2, "Date" LIMIT 5""", "supplier_panel")
def _(spark, d):
    panel = views.supplier_panel(spark, d).select(GID_2, DATE, CASES)
    return access.head(panel.orderBy(F.desc(CASES), GID_2, DATE), 5)


@query("single_precision", """
  SELECT event_id, CAST(value AS FLOAT) AS value FROM events""")
def _(spark, d):
    return access.to_float32(views.table(spark, d, "events").select("event_id", "value"))


@query("first_row_per_key", """
  SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def _(spark, d):
    return readers.first_row(views.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("statistics_updated", """
  SELECT metric, "Date", GID_2, round(mean * (CASE WHEN year("Date") >= 2000 THEN 2 ELSE 1 END), 6) AS mean
  FROM climate_stats""", "climate_stats")
def _(spark, d):
    records = views.climate_stats(spark, d).select("metric", DATE, GID_2, "mean")
    kept = store.StatStore(spark, f"{_folder(spark)}/statistics")
    kept.add(records)
    kept.add(records.where(F.year(DATE) >= 2000).withColumn("mean", F.col("mean") * 2))
    kept.compact()
    return store.newest(kept.records).withColumn("mean", F.round("mean", 6))


@query("stacked_horizons", """
  SELECT horizon + 10 AS horizon, GID_2, "Date", round(prediction, 6) AS prediction FROM baseline_forecast WHERE quantile = 0.5""",
       "baseline_forecast")
def _(spark, d):
    medians = access.pick(views.baseline_forecast(spark, d), quantile=0.5)
    by_horizon = {h + 10: access.pick(medians, horizon=h).drop(HORIZON) for h in views.HORIZONS}
    return ensemble.stack_horizons(by_horizon).select(HORIZON, GID_2, DATE, F.round(PREDICTION, 6).alias(PREDICTION))


@query("model_run_and_stored", """
  SELECT GID_2, "Date", horizon, quantile, round(prediction, 6) AS prediction, Cases FROM baseline_forecast""", "baseline_forecast")
def _(spark, d):
    out = models.run_model("baseline", views.supplier_panel(spark, d), path=_folder(spark), horizon=views.HORIZONS)
    return out.select(GID_2, DATE, HORIZON, QUANTILE, F.round(PREDICTION, 6).alias(PREDICTION), F.col(CASES).cast("double").alias(CASES))


@query("interval_scores", """
  SELECT GID_2, "Date", horizon, round(max(CASE WHEN quantile = 0.9 THEN prediction END) - max(CASE WHEN quantile = 0.1 THEN prediction END)
    + 10 * greatest(max(CASE WHEN quantile = 0.1 THEN prediction END) - any_value(Cases), 0)
    + 10 * greatest(any_value(Cases) - max(CASE WHEN quantile = 0.9 THEN prediction END), 0), 5) AS score
  FROM baseline_forecast WHERE prediction IS NOT NULL GROUP BY 1, 2, 3""", "baseline_forecast")
def _(spark, d):
    rows = views.baseline_forecast(spark, d).where(F.col(PREDICTION).isNotNull())
    at = lambda q: F.max(F.when(F.round(QUANTILE, 6) == q, F.col(PREDICTION)))
    ends = rows.groupBy(GID_2, DATE, HORIZON).agg(at(0.1).alias("low"), at(0.9).alias("high"), F.max(CASES).cast("double").alias("y"))
    score = interval_score(F.col("y"), F.col("low"), F.col("high"), F.lit(0.2))
    return ends.select(GID_2, DATE, HORIZON, F.round(score, 5).alias("score"))
