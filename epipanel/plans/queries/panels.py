"""Panel building, access and checks over the sample tables."""

from pyspark.sql import functions as F

from epipanel.functions import periods, scalars
from epipanel.operators import access, checks, panel, regions
from epipanel.plans import views
from epipanel.plans.catalog import cte, query
from epipanel.plans.views import WEEK_SAT, WEEK_SUN, sql_grid
from epipanel.schema import CASES, DATE, FUTURE, GID_1, GID_2
from epipanel.sources import tables

cte("week_sat_panel", sql_grid("event_list", "count(*)", WEEK_SAT, "7 day"), "event_list")
cte("week_sun_panel", sql_grid("event_list", "count(*)", WEEK_SUN, "7 day"), "event_list")
cte("day_panel", sql_grid("event_list", "count(*)", '"Date"', "1 day"), "event_list")


@query("cases_per_month", 'SELECT GID_2, "Date", GID_1, Cases FROM nation_panel', "nation_panel")
def _(spark, d):
    return views.nation_panel(spark, d)


@query("cases_per_month_counted", 'SELECT * FROM supplier_panel', "supplier_panel")
def _(spark, d):
    return views.supplier_panel(spark, d)


@query("cases_per_week_sat", 'SELECT GID_2, "Date", GID_1, Cases FROM week_sat_panel', "week_sat_panel")
def _(spark, d):
    return panel.cases_per_week(views.event_list(spark, d))


@query("cases_per_week_sun", 'SELECT GID_2, "Date", GID_1, Cases FROM week_sun_panel', "week_sun_panel")
def _(spark, d):
    return panel.cases_per_week(views.event_list(spark, d), week="W-SUN")


@query("cases_per_day", 'SELECT GID_2, "Date", GID_1, Cases FROM day_panel', "day_panel")
def _(spark, d):
    return panel.cases_per_day(views.event_list(spark, d))


cte("selected_cases", """
  SELECT * FROM line_list WHERE Status IN ('F', 'O') AND "Date" <= DATE '1999-06-15'""", "line_list")
cte("selected_panel", sql_grid("selected_cases", "count(*)", 'last_day("Date")', "1 month"), "selected_cases")


@query("cases_by_status_and_cutoff", 'SELECT GID_2, "Date", GID_1, Cases FROM selected_panel', "selected_panel")
def _(spark, d):
    return panel.cases_per_month(views.line_list(spark, d), statuses=["F", "O"], cutoff_date="1999-06-15")


@query("cases_observed_only", """
  SELECT c.GID_2, c."Date", c.Cases, g.GID_1
  FROM (SELECT GID_2, last_day("Date") AS "Date", count(*) AS Cases FROM line_list GROUP BY 1, 2) c
  JOIN (SELECT GID_2, arg_max(GID_1, ("Date", GID_1)) AS GID_1 FROM line_list GROUP BY 1) g USING (GID_2)
""", "line_list")
def _(spark, d):
    return panel.cases_per_month(views.line_list(spark, d), fill=False)


@query("cutoff_report", """
  SELECT count(*) FILTER (WHERE "Date" > DATE '1999-06-15') AS removed,
         count(*) FILTER (WHERE "Date" <= DATE '1999-06-15') AS remaining FROM line_list""", "line_list")
def _(spark, d):
    return access.cutoff_report(views.line_list(spark, d), "1999-06-15")


@query("case_reconciliation", """
  SELECT a.n AS incoming, b.n AS outgoing, a.n = b.n AS matches
  FROM (SELECT CAST(sum(Cases) AS BIGINT) AS n FROM counted_list) a,
       (SELECT CAST(sum(Cases) AS BIGINT) AS n FROM supplier_panel) b""", "counted_list", "supplier_panel")
def _(spark, d):
    rows = views.counted_list(spark, d)
    return panel.reconcile(rows, panel.cases_per_month(rows))


@query("total_cases_per_month", """
  SELECT "Date", CAST(sum(Cases) AS BIGINT) AS Cases FROM nation_panel GROUP BY 1""", "nation_panel")
def _(spark, d):
    return panel.total_per_date(views.nation_panel(spark, d))


cte("europe_panel", sql_grid("europe_list", "count(*)", 'last_day("Date")', "1 month"), "europe_list")
cte("europe_list", "SELECT * FROM line_list WHERE GID_1 IN ('EUROPE', 'ASIA')", "line_list")


@query("pad_regions", """
  SELECT GID_2, "Date", GID_1, Cases FROM europe_panel
  UNION ALL
  SELECT r.GID_2, p."Date", r.GID_1, 0 FROM region_dim r, (SELECT DISTINCT "Date" FROM europe_panel) p
  WHERE r.GID_2 NOT IN (SELECT GID_2 FROM europe_panel)""", "europe_panel", "region_dim")
def _(spark, d):
    part = access.filter_admin1(views.line_list(spark, d), ["EUROPE", "ASIA"])
    return panel.pad_regions(panel.cases_per_month(part), views.region_dim(spark, d), "TST").select(
        GID_2, DATE, GID_1, CASES)


@query("future_rows", "SELECT * FROM supplier_future", "supplier_future")
def _(spark, d):
    return views.supplier_future(spark, d)


@query("history_and_future", """
  SELECT future, count(*) AS n, count(DISTINCT GID_2) AS regions FROM supplier_future GROUP BY 1""",
       "supplier_future")
def _(spark, d):
    return checks.split_future(views.supplier_future(spark, d))


@query("history_only", 'SELECT GID_2, "Date", Cases FROM supplier_future WHERE NOT future', "supplier_future")
def _(spark, d):
    return access.history(views.supplier_future(spark, d)).select(GID_2, DATE, CASES)


@query("reindexed_climate", """
  SELECT g.GID_2, g."Date", round(c.tmin, 6) AS tmin
  FROM (SELECT GID_2, "Date" FROM (SELECT DISTINCT GID_2 FROM climate), (SELECT DISTINCT "Date" FROM supplier_panel)) g
  LEFT JOIN climate c ON c.GID_2 = g.GID_2 AND c."Date" = g."Date"
  WHERE g."Date" BETWEEN DATE '1996-03-31' AND DATE '2000-12-31'""", "climate", "supplier_panel")
def _(spark, d):
    sparse = views.climate(spark, d).select(GID_2, DATE, "tmin")
    full = panel.reindex(sparse, "M", start="1996-03-10", end="2000-12-02", check=False)
    return full.select(GID_2, DATE, F.round("tmin", 6).alias("tmin"))


@query("statuses_merged", """
  SELECT "Date", GID_2, CAST(sum(Cases) AS BIGINT) AS Cases, bool_or(future) AS future
  FROM (SELECT last_day("Date") AS "Date", GID_2, Cases, "Date" > DATE '2001-06-30' AS future FROM counted_list)
  GROUP BY 1, 2""", "counted_list")
def _(spark, d):
    rows = views.counted_list(spark, d).withColumn(FUTURE, F.col(DATE) > F.lit("2001-06-30").cast("date"))
    return panel.merge_statuses(rows.withColumn(DATE, periods.period_end(F.col(DATE))))


@query("history_nulls_to_zero", """
  SELECT GID_2, "Date", future, CASE WHEN future THEN Cases ELSE COALESCE(Cases, 0) END AS Cases
  FROM (SELECT GID_2, "Date", future, NULLIF(Cases, 30) AS Cases FROM supplier_future)""", "supplier_future")
def _(spark, d):
    holes = views.supplier_future(spark, d).withColumn(CASES, F.nullif(F.col(CASES), F.lit(30)))
    return access.zero_missing_history(holes).select(GID_2, DATE, FUTURE, CASES)


@query("duplicate_region_dates", """
  SELECT "Date", GID_2, count(*) AS n FROM counted_list GROUP BY 1, 2 HAVING count(*) > 1""", "counted_list")
def _(spark, d):
    return checks.duplicate_keys(views.counted_list(spark, d), [DATE, GID_2])


@query("missing_combinations", """
  SELECT g.GID_2, g."Date" FROM (SELECT * FROM (SELECT DISTINCT GID_2 FROM climate), (SELECT DISTINCT "Date" FROM climate)) g
  WHERE NOT EXISTS (SELECT 1 FROM climate c WHERE c.GID_2 = g.GID_2 AND c."Date" = g."Date")""", "climate")
def _(spark, d):
    return checks.missing_combinations(views.climate(spark, d))


@query("regions_with_cases", """
  SELECT GID_2, COALESCE(bool_or(CASE WHEN "Date" BETWEEN DATE '1995-01-01' AND DATE '1995-01-31'
         THEN Cases > 0 END), false) AS active FROM supplier_panel GROUP BY 1""", "supplier_panel")
def _(spark, d):
    return checks.active_regions(views.supplier_panel(spark, d), "1995-01-01", "1995-01-31")


@query("status_rows", "SELECT Status, count(*) AS n FROM line_list GROUP BY 1", "line_list")
def _(spark, d):
    return checks.rows_per(views.line_list(spark, d), "Status")


@query("distinct_counts", """
  SELECT count(DISTINCT GID_2) AS GID_2, count(DISTINCT "Date") AS "Date" FROM counted_list""", "counted_list")
def _(spark, d):
    return checks.distinct_counts(views.counted_list(spark, d), [GID_2, DATE])


@query("date_window", """
  SELECT GID_2, "Date", Cases FROM supplier_panel WHERE "Date" BETWEEN
   greatest(DATE '1990-01-31', (SELECT min("Date") FROM supplier_panel)) AND
   least(DATE '1998-02-28', (SELECT max("Date") FROM supplier_panel))""", "supplier_panel")
def _(spark, d):
    return access.between_dates(views.supplier_panel(spark, d), "1990-01-05", "1998-02-10").select(
        GID_2, DATE, CASES)


@query("masked_rows", 'SELECT GID_2, "Date", Cases FROM supplier_panel WHERE Cases > 100', "supplier_panel")
def _(spark, d):
    return access.mask(views.supplier_panel(spark, d), F.col(CASES) > 100).select(GID_2, DATE, CASES)


@query("sql_filter", """
  SELECT GID_2, "Date", Cases FROM supplier_panel WHERE Cases = 0 AND "Date" >= DATE '2000-01-01'""",
       "supplier_panel")
def _(spark, d):
    rows = access.query(views.supplier_panel(spark, d), "Cases = 0 AND Date >= DATE '2000-01-01'")
    return access.columns(rows, GID_2, DATE, CASES)


@query("row_slice", """
  SELECT GID_2, "Date", Cases FROM supplier_panel ORDER BY "Date", GID_2 LIMIT 30 OFFSET 15""", "supplier_panel")
def _(spark, d):
    return access.row_slice(views.supplier_panel(spark, d), 15, 45, [DATE, GID_2]).select(GID_2, DATE, CASES)


@query("free_sql", """
  SELECT GID_1, CAST(max(Cases) AS BIGINT) AS peak, count(*) AS n FROM supplier_panel GROUP BY 1""", "supplier_panel")
def _(spark, d):
    tables.as_view(views.supplier_panel(spark, d), "epipanel_data")
    return spark.sql("SELECT GID_1, max(Cases) AS peak, count(*) AS n FROM epipanel_data GROUP BY GID_1")


@query("filter_by_values", """
  SELECT "Date", GID_2 FROM line_list WHERE Status = 'F' AND GID_1 = 'ASIA'""", "line_list")
def _(spark, d):
    return access.filter_equal(views.line_list(spark, d), {"Status": "F", GID_1: "ASIA"}).select(DATE, GID_2)


@query("period_calendar", """
  SELECT "Date", last_day("Date") AS month_end, CAST(date_trunc('month', "Date") AS DATE) AS month_start,
         """ + WEEK_SUN + """ AS week_sun, """ + WEEK_SAT + """ AS week_sat,
         CAST(year("Date") * 12 + month("Date") - 1 AS INTEGER) AS month_no,
         last_day(CAST(date_trunc('month', "Date") - INTERVAL 7 MONTH AS DATE)) AS back7,
         round(sin(2 * pi() * month("Date") / 12), 6) AS sin_month,
         round(cos(2 * pi() * month("Date") / 12), 6) AS cos_month
  FROM line_list""", "line_list")
def _(spark, d):
    day = F.col(DATE)
    sin_month, cos_month = periods.month_cycle(day)
    return views.line_list(spark, d).select(
        DATE, periods.period_end(day, "M").alias("month_end"), periods.period_start(day, "M").alias("month_start"),
        periods.period_end(day, "W-SUN").alias("week_sun"), periods.period_end(day, "W-SAT").alias("week_sat"),
        periods.period_index(day, "M").alias("month_no"), periods.add_periods(day, -7, "M").alias("back7"),
        F.round(sin_month, 6).alias("sin_month"), F.round(cos_month, 6).alias("cos_month"),
    )


@query("aligned_dates", """
  SELECT GID_2, last_day("Date") AS "Date", count(*) AS n FROM event_list GROUP BY 1, 2""", "event_list")
def _(spark, d):
    monthly = views.nation_panel(spark, d)
    return checks.rows_per(periods.align_dates(views.event_list(spark, d), monthly), GID_2, DATE)


@query("region_codes", """
  SELECT GID_2, CAST(dense_rank() OVER (ORDER BY GID_2) - 1 AS INTEGER) AS GID_2_codes
  FROM (SELECT DISTINCT GID_2 FROM counted_list)""", "counted_list")
def _(spark, d):
    return regions.region_codes(views.counted_list(spark, d))


@query("time_index", """
  SELECT GID_2, "Date", CAST(dense_rank() OVER (ORDER BY "Date") AS INTEGER) AS "TIME" FROM supplier_panel""",
       "supplier_panel")
def _(spark, d):
    return regions.time_index(views.supplier_panel(spark, d)).select(GID_2, DATE, "TIME")


@query("first_regions", """
  SELECT GID_2, "Date", Cases FROM supplier_panel
  WHERE GID_2 IN (SELECT DISTINCT GID_2 FROM supplier_panel ORDER BY GID_2 LIMIT 10)""", "supplier_panel")
def _(spark, d):
    return regions.first_regions(views.supplier_panel(spark, d), 10).select(GID_2, DATE, CASES)


@query("region_id_parts", """
  SELECT GID_2, split_part(GID_2, '.', 1) AS country, regexp_extract(GID_2, '^([^.]+\\.[0-9]+)', 1) || '_1' AS GID_1
  FROM (SELECT DISTINCT GID_2 FROM counted_list)""", "counted_list")
def _(spark, d):
    ids = views.counted_list(spark, d).select(GID_2).distinct()
    return ids.select(GID_2, scalars.country_of(F.col(GID_2)).alias("country"),
                      scalars.admin1_of(F.col(GID_2)).alias(GID_1))
