"""From line lists to dense region x period panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.functions.periods import add_periods, align_scalar, period_end, period_range
from epipanel.operators import access
from epipanel.operators.checks import assert_unique
from epipanel.schema import (
    CASES, DATE, FUTURE, GID_1, GID_2, one_row, period_freq, require_columns, with_period,
)
from epipanel.sources.stage import stage


def _bounds(df: DataFrame, date: Column) -> Column:
    return one_row(df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi"))))


def densify(
    df: DataFrame,
    freq: str,
    bounds: Column,
    fill: dict[str, object] | None = None,
    carry: Sequence[str] = (),
    key: str = GID_2,
) -> DataFrame:
    """Give every region a row for every period of ``bounds``.

    Each row spreads over the periods up to the region's next one, so the grid
    needs one shuffle by region and no join. ``fill`` values go into the new
    rows, ``carry`` columns keep the region's value, other columns become null.
    """
    fill = fill or {}
    w = Window.partitionBy(key).orderBy(DATE)
    first = F.row_number().over(w) == 1
    following = F.lead(DATE).over(w)
    gaps = df.withColumns({
        "_from": F.when(first, bounds["lo"]).otherwise(F.col(DATE)),
        "_to": F.coalesce(add_periods(following, -1, freq), bounds["hi"]),
    })
    spread = gaps.withColumn("_d", F.explode(period_range(F.col("_from"), F.col("_to"), freq)))
    own = F.col("_d") == F.col(DATE)
    out = []
    for c in df.columns:
        if c == DATE:
            out.append(F.col("_d").alias(DATE))
        elif c == key or c in carry:
            out.append(F.col(c))
        else:
            out.append(F.when(own, F.col(c)).otherwise(F.lit(fill.get(c))).alias(c))
    return with_period(spread.select(*out), freq)


def aggregate_cases(
    df: DataFrame,
    statuses: Sequence[str] | None = None,
    cases: str = CASES,
    cutoff_date: str | None = None,
    fill: bool = True,
    freq: str = "M",
) -> DataFrame:
    """Count cases per region and period.

    Without a count column every row is one case. With ``fill`` every region
    gets every period between the first and the last of the data, zero where
    nothing happened; descriptive columns take the region's earliest value.
    Without ``fill`` only observed periods appear, with the region's latest
    ``GID_1``.
    """
    require_columns(df, [DATE, GID_2, GID_1])
    rows = access.cutoff(access.filter_status(df, statuses), cutoff_date)
    amount = F.col(cases) if cases in df.columns else F.lit(1)
    describe = [c for c in df.columns if c not in (GID_2, DATE, cases, "Status")]
    pick = F.min if fill else F.max
    counted = (
        rows.where(F.col(DATE).isNotNull())
        .groupBy(GID_2, period_end(F.col(DATE), freq).alias("_p"))
        .agg(F.sum(amount).cast("long").alias(cases),
             pick(F.struct(F.col(DATE), *describe)).alias("_about"))
    )
    if fill:
        # counts are read twice, the line list once
        counted = stage(counted)
        bounds = _bounds(counted, F.col("_p"))
    counted = counted.where(F.col(GID_2).isNotNull())
    about = F.first if fill else F.last
    whole = Window.partitionBy(GID_2).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    kept = describe if fill else [GID_1]
    counted = counted.withColumn("_region", about("_about").over(whole)).select(
        F.col("_p").alias(DATE), GID_2, cases, *[F.col("_region")[c].alias(c) for c in kept]
    )
    if not fill:
        return with_period(counted, freq)
    return densify(counted, freq, bounds, fill={cases: 0}, carry=describe)


def cases_per_month(df: DataFrame, **options) -> DataFrame:
    return aggregate_cases(df, freq="M", **options)


def cases_per_week(df: DataFrame, week: str = "W-SAT", **options) -> DataFrame:
    return aggregate_cases(df, freq=week, **options)


def cases_per_day(df: DataFrame, **options) -> DataFrame:
    return aggregate_cases(df, freq="D", **options)


def reconcile(before: DataFrame, after: DataFrame, cases: str = CASES) -> DataFrame:
    """Cases going in and coming out of a step, and whether they agree."""
    amount = F.col(cases) if cases in before.columns else F.lit(1)
    incoming = before.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("incoming"))
    outgoing = after.agg(F.coalesce(F.sum(cases), F.lit(0)).cast("long").alias("outgoing"))
    both = incoming.withColumn("outgoing", outgoing.scalar())
    return both.withColumn("matches", F.col("incoming") == F.col("outgoing"))


def reindex(df: DataFrame, freq: str | None = None, start: str | None = None, end: str | None = None,
            check: bool = True) -> DataFrame:
    """Full region x period grid, missing values left null; keys must be unique."""
    freq = freq or period_freq(df) or "M"
    if check:
        assert_unique(df, [DATE, GID_2])
    marked = with_period(df, freq)
    grid = densify(marked, freq, _bounds(df, F.col(DATE)))
    if start is not None:
        grid = grid.where(F.col(DATE) >= align_scalar(start, grid))
    if end is not None:
        grid = grid.where(F.col(DATE) <= align_scalar(end, grid))
    return grid


def date_list(df: DataFrame) -> Column:
    """All dates of the data as one sorted array; as long as the calendar, not the data."""
    return df.agg(F.array_sort(F.collect_set(DATE))).scalar()


def pad_regions(panel: DataFrame, regions: DataFrame, iso3: str | None = None) -> DataFrame:
    """Zero rows, on every date of the panel, for reference regions it lacks."""
    require_columns(panel, [GID_2])
    if iso3 is not None:
        regions = regions.where(F.col("GID_0") == iso3)
    absent = regions.join(panel.select(GID_2).distinct(), GID_2, "left_anti")
    fills = {
        GID_1: F.col(GID_1), GID_2: F.col(GID_2), CASES: F.lit(0).cast("long"),
        "ADM1": F.col("NAME_1"), "ADM2": F.col("NAME_2"),
    }
    rows = absent.withColumn(DATE, F.explode(date_list(panel)))
    zeros = rows.select(DATE, *[v.alias(k) for k, v in fills.items() if k in panel.columns])
    return panel.unionByName(zeros, allowMissingColumns=True)


def add_future(panel: DataFrame, n: int = 12, freq: str | None = None) -> DataFrame:
    """Append ``n`` periods after the last one: copies of the last rows, cases unknown."""
    freq = freq or period_freq(panel) or "M"
    last = one_row(panel.agg(F.max(DATE)))
    ahead = (
        panel.where(F.col(DATE) == last)
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn(DATE, add_periods(F.col(DATE), F.col("_n"), freq))
        .drop("_n")
        .withColumns({CASES: F.lit(None).cast(panel.schema[CASES].dataType), FUTURE: F.lit(True)})
    )
    return with_period(panel.withColumn(FUTURE, F.lit(False)).unionByName(ahead), freq)


def merge_statuses(df: DataFrame) -> DataFrame:
    """One row per date and region: cases added up, future if any part is."""
    return df.groupBy(DATE, GID_2).agg(
        F.sum(CASES).alias(CASES), F.bool_or(FUTURE).alias(FUTURE)
    )


def total_per_date(panel: DataFrame) -> DataFrame:
    return panel.groupBy(DATE).agg(F.sum(CASES).cast("long").alias(CASES))


def last_region_value(df: DataFrame, column: str, order: str = DATE) -> DataFrame:
    """Latest value of a descriptive column per region."""
    return df.groupBy(GID_2).agg(F.max_by(column, F.struct(order, column)).alias(column))


def first_region_value(df: DataFrame, column: str, order: str = DATE) -> DataFrame:
    """Earliest value of a descriptive column per region."""
    return df.groupBy(GID_2).agg(F.min_by(column, F.struct(order, column)).alias(column))
