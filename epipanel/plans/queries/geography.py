"""Region names, gridded values, adjacency and hexagons over the sample tables."""

import calendar

from pyspark.sql import functions as F

from epipanel.functions import scalars
from epipanel.operators import regions, summaries, zonal
from epipanel.plans import views
from epipanel.plans.catalog import cte, query
from epipanel.schema import CASES, DATE, GID_1, GID_2
from epipanel.sources import readers


def _noisy_rows(spark, d):
    """Customers with their nation and region names written in various ways."""
    customer, nation = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    region = views.table(spark, d, "region")
    name, kind = F.col("n_name"), F.col("c_custkey") % 4
    two = (
        F.when(kind == 0, F.lower(name)).when(kind == 1, F.replace(name, F.lit("T"), F.lit(" T ")))
        .when(kind == 2, F.replace(name, F.lit("A"), F.lit("Á"))).otherwise(F.concat(F.lit("x"), name)))
    one = F.when(F.col("c_custkey") % 8 == 3, F.concat("r_name", F.lit("X"))).otherwise(F.lower("r_name"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", one.alias("ADM1"), two.alias("ADM2")))


cte("noisy_rows", """
  SELECT c_custkey, CASE WHEN c_custkey % 8 = 3 THEN r_name || 'X' ELSE lower(r_name) END AS ADM1,
    CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, 'T', ' T ')
      WHEN 2 THEN replace(n_name, 'A', 'Á') ELSE 'x' || n_name END AS ADM2
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


def _h(x):
    return f"lower(replace(strip_accents({x}), ' ', ''))"


def _sorted(x):
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def _lcs(a, b):
    """Longest common subsequence of two texts, by one list per row of the table."""
    codes = f"list_transform(string_split({b}, ''), lambda c: unicode(c))"
    inner = (f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: "
             f"list_append(acc, CASE WHEN ({codes})[j[1]] = ch[1] THEN rw[j[1]] + 1 "
             f"ELSE greatest(acc[length(acc)], rw[j[1] + 1]) END), [0::BIGINT])")
    letters = f"list_transform(string_split({a}, ''), lambda c: [unicode(c)::BIGINT])"
    zeros = f"list_transform(range(length({b}) + 1), lambda z: 0::BIGINT)"
    return f"list_last(list_reduce({letters}, lambda rw, ch: {inner}, {zeros}))"


def _ratio(a, b):
    return f"200.0 * {_lcs(a, b)} / (length({a}) + length({b}))"


def _best(source, name, candidate):
    """Best candidate of each distinct name with a ratio of at least 90."""
    return f"""
  SELECT q, arg_min(m, (-score, o)) AS m, max(score) AS score FROM (
    SELECT q, m, o, {_ratio("qs", "ms")} AS score FROM
      (SELECT DISTINCT {name} AS q, {_sorted(name)} AS qs FROM {source} WHERE NAME_2 IS NULL) a
      CROSS JOIN (SELECT {candidate} AS m, min(GID_2) AS o, {_sorted(candidate)} AS ms FROM region_dim GROUP BY 1) b)
  WHERE score >= 90 GROUP BY q"""


cte("exact_names", f"""
  SELECT n.*, r.NAME_1, r.NAME_2 FROM (SELECT DISTINCT ADM1, ADM2 FROM noisy_rows) n
  LEFT JOIN (SELECT {_h("NAME_1")} AS h1, {_h("NAME_2")} AS h2, NAME_1, NAME_2 FROM region_dim) r
    ON r.h1 = {_h("n.ADM1")} AND r.h2 = {_h("n.ADM2")}""", "noisy_rows", "region_dim")
cte("best_two", _best("exact_names", "ADM2", "NAME_2"), "exact_names", "region_dim")
cte("best_one", _best("exact_names", "ADM1", "NAME_1"), "exact_names", "region_dim")
cte("resolved_names", """
  SELECT e.ADM1, e.ADM2, COALESCE(e.NAME_1, o.m) AS NAME_1, COALESCE(e.NAME_2, t.m) AS NAME_2
  FROM exact_names e LEFT JOIN best_one o ON o.q = e.ADM1 AND e.NAME_1 IS NULL
  LEFT JOIN best_two t ON t.q = e.ADM2 AND e.NAME_2 IS NULL""", "exact_names", "best_one", "best_two")


@query("names_matched_exactly", "SELECT * FROM exact_names", "exact_names")
def _(spark, d):
    names = _noisy_rows(spark, d).select("ADM1", "ADM2").distinct()
    return regions.match_exact(names, views.region_dim(spark, d), "ADM1", "ADM2").select("ADM1", "ADM2", "NAME_1", "NAME_2")


@query("names_matched_fuzzily", "SELECT q AS ADM2, m AS NAME_2, round(score, 6) AS score FROM best_two", "best_two")
def _(spark, d):
    dim = views.region_dim(spark, d)
    names = regions.match_exact(_noisy_rows(spark, d).select("ADM1", "ADM2").distinct(), dim, "ADM1", "ADM2")
    out = regions.fuzzy_match(names.where("NAME_2 IS NULL"), dim, "ADM2", "NAME_2", GID_2)
    return out.withColumn("score", F.round("score", 6))


@query("aligned_regions", """
  SELECT n.c_custkey, d.NAME_1 AS ADM1, d.NAME_2 AS ADM2, d.GID_1, d.GID_2
  FROM noisy_rows n JOIN resolved_names r USING (ADM1, ADM2)
  JOIN region_dim d ON d.NAME_1 = r.NAME_1 AND d.NAME_2 = r.NAME_2""", "resolved_names")
def _(spark, d):
    return regions.align_regions(_noisy_rows(spark, d), views.region_dim(spark, d))


@query("unmatched_names", "SELECT ADM1, ADM2 FROM resolved_names WHERE NAME_1 IS NULL OR NAME_2 IS NULL", "resolved_names")
def _(spark, d):
    return regions.unmatched_names(_noisy_rows(spark, d), views.region_dim(spark, d), "ADM1", "ADM2")


@query("token_sort_ratio", f"""
  SELECT a, b, round({_ratio("a2", "b2")}, 6) AS ratio FROM (
    SELECT a, b, {_sorted("a")} AS a2, {_sorted("b")} AS b2 FROM (
      SELECT DISTINCT p_name AS a, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') || 's' AS b FROM part))""")
def _(spark, d):
    names = views.table(spark, d, "part").select(
        F.col("p_name").alias("a"),
        F.concat(F.array_join(F.reverse(F.split("p_name", " ")), " "), F.lit("s")).alias("b")).distinct()
    return names.withColumn("ratio", F.round(scalars.token_sort_ratio(F.col("a"), F.col("b")), 6))


@query("homogenised_names", f"""
  SELECT DISTINCT ADM1, ADM2, {_h("ADM1")} AS h1, {_h("ADM2")} AS h2 FROM noisy_rows""", "noisy_rows")
def _(spark, d):
    names = _noisy_rows(spark, d).select("ADM1", "ADM2").distinct()
    return names.withColumns({"h1": scalars.homogenise(F.col("ADM1")), "h2": scalars.homogenise(F.col("ADM2"))})


@query("state_ids_by_name", "SELECT DISTINCT GID_1 FROM region_dim WHERE NAME_1 IN ('ASIA', 'EUROPE')", "region_dim")
def _(spark, d):
    return regions.lookup_gid1(views.region_dim(spark, d), ["ASIA", "EUROPE"])


@query("region_reference_layer", "SELECT * FROM region_dim", "region_dim")
def _(spark, d):
    return readers.region_dimension(views.region_dim(spark, d))


@query("names_by_code", """
  SELECT c.c_custkey, CAST(c.c_nationkey + 5 AS VARCHAR) AS code, r.r_name AS ADM1, n.n_name AS ADM2
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey + 5
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def _(spark, d):
    nation, region = views.table(spark, d, "nation"), views.table(spark, d, "region")
    listed = nation.join(region, nation.n_regionkey == region.r_regionkey)
    codes = readers.municipality_codes(listed, "n_nationkey", "r_name", "n_name")
    rows = views.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 5).cast("string").alias("code"))
    return regions.add_names_by_code(rows, codes).select("c_custkey", "code", "ADM1", "ADM2")


@query("unmatched_codes", """
  SELECT count(*) AS unmatched FROM customer WHERE c_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)""")
def _(spark, d):
    codes = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("code"))
    rows = views.table(spark, d, "customer").select((F.col("c_nationkey") + 5).alias("code"))
    return regions.unmatched_codes(rows, codes)


@query("weekly_feed_to_months", """
  SELECT code, last_day("Date") AS "Date", CAST(sum(Cases) AS BIGINT) AS Cases FROM (
    SELECT CAST(epoch_ms(ms) AS DATE) AS "Date", code, Cases FROM (
      SELECT CAST(epoch_ms(date_trunc('week', o_orderdate)) AS BIGINT) AS ms, CAST(o_custkey % 100 AS VARCHAR) AS code,
             count(*) AS Cases FROM orders GROUP BY 1, 2)) GROUP BY 1, 2""")
def _(spark, d):
    feed = views.table(spark, d, "orders").groupBy(
        (F.unix_date(F.to_date(F.date_trunc("week", "o_orderdate"))).cast("long") * 86400000).alias("data_iniSE"),
        (F.col("o_custkey") % 100).alias("Localidade_id")).agg(F.count("*").alias("casos"))
    return readers.monthly_totals(readers.weekly_records(feed)).select("code", DATE, CASES)


cte("seasons", """
  SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, round(avg(o_totalprice) / 10000, 2) AS total,
         round((avg(o_totalprice) - 250000) / 10000, 2) AS anom FROM orders GROUP BY 1, 2""")


@query("climate_index_text", """
  SELECT last_day(make_date(yr, mo, 1)) AS "Date", total AS TotalONI, anom AS AnomONI FROM seasons""", "seasons")
def _(spark, d):
    codes = F.array(*map(F.lit, "DJF JFM FMA MAM AMJ MJJ JJA JAS ASO SON OND NDJ".split()))
    monthly = views.table(spark, d, "orders").groupBy(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("p"))
    text = monthly.select(F.concat(
        F.lit("  "), F.element_at(codes, F.col("m")), F.lit("   "), F.col("y").cast("string"), F.lit("  "),
        F.round(F.col("p") / 10000, 2).cast("string"), F.lit("   "),
        F.round((F.col("p") - 250000) / 10000, 2).cast("string")).alias("value"))
    return readers.climate_index(text)


def _cells(spark, d):
    """Line items as readings of map cells on a 50 x 50 grid."""
    return views.table(spark, d, "lineitem").select(
        F.lit("prec").alias("metric"), F.last_day(F.to_date("l_shipdate")).alias(DATE),
        (F.col("l_partkey") % 50 + 0.5).cast("double").alias("x"),
        (F.floor(F.col("l_partkey") / 50) % 50 + 0.5).cast("double").alias("y"), F.col("l_quantity").alias("value"))


cte("cells", """
  SELECT last_day(CAST(l_shipdate AS DATE)) AS "Date", CAST(l_partkey % 50 + 0.5 AS DOUBLE) AS x,
         CAST((l_partkey // 50) % 50 + 0.5 AS DOUBLE) AS y, l_quantity AS value FROM lineitem""")


def _vertices(spark, d):
    """Nations as squares of ten cells that tile the grid."""
    k = F.col("n_nationkey")
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(cx).alias("cx"), F.lit(cy).alias("cy"))
                        for i, (cx, cy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])])
    return views.table(spark, d, "nation").withColumn("c", F.explode(corners)).select(
        F.col("n_name").alias(GID_2), F.lit(0).alias("ring"), F.col("c.seq").alias("seq"),
        ((k % 5 + F.col("c.cx")) * 10).cast("double").alias("x"),
        ((F.floor(k / 5) + F.col("c.cy")) * 10).cast("double").alias("y"))


cte("squares", "SELECT n_name AS GID_2, n_nationkey % 5 AS cx, n_nationkey // 5 AS cy FROM nation")


@query("zonal_statistics", """
  SELECT s.GID_2, c."Date", 'prec' AS metric, round(avg(value), 6) AS mean, sum(value) AS sum
  FROM cells c JOIN squares s ON floor(c.x / 10) = s.cx AND floor(c.y / 10) = s.cy GROUP BY 1, 2""", "cells", "squares")
def _(spark, d):
    out = zonal.measured(zonal.zonal_stats(_cells(spark, d), _vertices(spark, d), tile=10.0))
    return out.withColumn("mean", F.round("mean", 6))


@query("point_in_region", """
  SELECT DISTINCT c.x, c.y, s.GID_2 FROM cells c JOIN squares s ON floor(c.x / 10) = s.cx AND floor(c.y / 10) = s.cy""",
       "cells", "squares")
def _(spark, d):
    return zonal.locate_points(_cells(spark, d), _vertices(spark, d), tile=10.0)


@query("region_neighbours", """
  SELECT a.GID_2, b.GID_2 AS neighbour FROM squares a, squares b
  WHERE a.GID_2 <> b.GID_2 AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1""", "squares")
def _(spark, d):
    return zonal.neighbours(_vertices(spark, d))


@query("region_centroids", "SELECT GID_2, cx * 10 + 5.0::DOUBLE AS x, cy * 10 + 5.0::DOUBLE AS y FROM squares", "squares")
def _(spark, d):
    return zonal.centroids(_vertices(spark, d))


_SIDE = 4.0
cte("hexagons", f"""
  SELECT 'h_' || c || '_' || r AS hex_id, c * 1.5 * {_SIDE} AS hx, (r + (c & 1) / 2.0) * sqrt(3.0) * {_SIDE} AS hy
  FROM range(0, 10) t(c), range(-1, 9) u(r)""")
cte("nation_totals", """
  SELECT GID_2, CAST(sum(Cases) AS DOUBLE) AS Cases FROM nation_panel GROUP BY 1""", "nation_panel")


def _totals(spark, d):
    return views.nation_panel(spark, d).groupBy(GID_2).agg(F.sum(CASES).cast("double").alias(CASES))


@query("hexmap_by_centroid", """
  SELECT hex_id, avg(Cases) AS Cases FROM (
    SELECT s.GID_2, arg_min(h.hex_id, (h.hx - s.cx * 10 - 5) ** 2 + (h.hy - s.cy * 10 - 5) ** 2) AS hex_id
    FROM squares s, hexagons h GROUP BY 1) JOIN nation_totals USING (GID_2) GROUP BY 1""",
       "squares", "hexagons", "nation_totals")
def _(spark, d):
    return zonal.hex_by_centroid(_totals(spark, d), _vertices(spark, d), _SIDE, CASES)


@query("hexmap_by_area", """
  SELECT hex_id, round(sum(n * Cases) / sum(n), 4) AS Cases FROM (
    SELECT hex_id, GID_2, count(*) AS n FROM (
      SELECT c.x, c.y, s.GID_2, arg_min(h.hex_id, (h.hx - c.x) ** 2 + (h.hy - c.y) ** 2) AS hex_id
      FROM (SELECT DISTINCT x, y FROM cells) c JOIN squares s ON floor(c.x / 10) = s.cx AND floor(c.y / 10) = s.cy, hexagons h
      GROUP BY ALL) GROUP BY ALL) JOIN nation_totals USING (GID_2) GROUP BY 1""",
       "cells", "squares", "hexagons", "nation_totals")
def _(spark, d):
    out = zonal.hex_by_area(_totals(spark, d), _vertices(spark, d), _cells(spark, d), _SIDE, CASES, tile=10.0)
    return out.withColumn(CASES, F.round(CASES, 4))


@query("map_summary", """
  SELECT GID_2, min(GID_1) AS GID_1, nullif(CAST(sum(Cases) AS BIGINT), 0) AS Cases FROM supplier_panel
  WHERE "Date" BETWEEN DATE '1995-01-31' AND DATE '2001-12-31' GROUP BY 1""", "supplier_panel")
def _(spark, d):
    return summaries.map_summary(views.supplier_panel(spark, d), CASES, "1995-01-31", "2001-12-31")


@query("map_summary_states", """
  SELECT GID_1, round(avg(tmin), 6) AS tmin FROM (
    SELECT GID_2, min(GID_1) AS GID_1, avg(tmin) AS tmin FROM covariate_panel
    WHERE "Date" BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1) GROUP BY 1""", "covariate_panel")
def _(spark, d):
    out = summaries.map_summary(views.covariate_panel(spark, d), "tmin", "1996-01-01", "1997-12-31", admin1=True)
    return out.withColumn("tmin", F.round("tmin", 6))


@query("state_totals_on_layer", """
  SELECT r.GID_1, r.NAME_1, CAST(t.Cases AS BIGINT) AS Cases
  FROM (SELECT GID_1, sum(Cases) AS Cases FROM nation_panel GROUP BY 1) t
  LEFT JOIN (SELECT DISTINCT GID_1, NAME_1 FROM region_dim) r ON r.GID_1 = t.GID_1""", "nation_panel", "region_dim")
def _(spark, d):
    totals = summaries.aggregate_by_admin(views.nation_panel(spark, d), 1, check=False)
    layer = views.region_dim(spark, d).select(GID_1, "NAME_1")
    return summaries.on_region_layer(totals, layer, GID_1).select(GID_1, "NAME_1", CASES)


@query("colour_scores", """
  SELECT GID_2, round((Cases - lo) / (hi - lo), 6) AS score,
         CAST(floor((Cases - lo) / (hi - lo) * 255) AS INTEGER) AS bucket
  FROM nation_totals, (SELECT min(Cases) AS lo, max(Cases) AS hi FROM nation_totals)""", "nation_totals")
def _(spark, d):
    out = summaries.scaled(_totals(spark, d), CASES)
    return out.select(GID_2, F.round("score", 6).alias("score"), scalars.score_bucket(F.col("score"), 256).alias("bucket"))


@query("symmetric_limit", """
  SELECT greatest(abs(min(AnomONI)), max(AnomONI)) AS "limit" FROM (SELECT round(AnomONI, 4) AS AnomONI FROM ocean_index)""",
       "ocean_index")
def _(spark, d):
    return summaries.symmetric_limit(views.ocean_index(spark, d).withColumn("AnomONI", F.round("AnomONI", 4)), "AnomONI")


# every month that the tables cover
MONTHS = [f"{y}-{m:02d}-{calendar.monthrange(y, m)[1]}" for y in range(1995, 2002) for m in range(1, 13)]


@query("case_matrix", "SELECT GID_2, " + ", ".join(
    f"""max(CASE WHEN "Date" = DATE '{m}' THEN Cases END) AS "{m}\"""" for m in MONTHS) + " FROM nation_panel GROUP BY 1", "nation_panel")
def _(spark, d):
    return summaries.pivot_dates(views.nation_panel(spark, d), CASES, MONTHS)


@query("no_cases_matrix", "SELECT GID_2, " + ", ".join(
    f"""CAST(max(CASE WHEN "Date" = DATE '{m}' THEN Cases = 0 END) AS INTEGER) AS "{m}\"""" for m in MONTHS)
    + " FROM supplier_panel GROUP BY 1", "supplier_panel")
def _(spark, d):
    return summaries.no_cases_matrix(views.supplier_panel(spark, d), MONTHS)


@query("embedding_blocks", """
  SELECT vec_id, CAST(i // 16 AS INTEGER) AS block, CAST(i % 16 AS INTEGER) AS place, embedding[i + 1] AS value
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)""")
def _(spark, d):
    firsts = readers.first_embedding(views.table(spark, d, "embeddings").withColumn(GID_2, F.col("vec_id")), "vec_id")
    out = None
    for i in range(4):
        block = readers.embedding_block(firsts, 16 * i, 16).select(
            F.col(GID_2).alias("vec_id"), F.lit(i).alias("block"), F.posexplode("embedding").alias("place", "value"))
        out = block if out is None else out.unionByName(block)
    return out
