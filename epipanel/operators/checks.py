"""Checks on panels and forecasts: each gives the offending rows as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.schema import CASES, DATE, FUTURE, GID_2, HORIZON, PREDICTION, require_columns


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """ValueError when a key comes twice."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"duplicate key {found[0].asDict()} for {list(keys)}")


def missing_combinations(df: DataFrame, key: str = GID_2, date: str = DATE) -> DataFrame:
    """(region, date) pairs absent from the panel, over the dates it has anywhere."""
    every = df.agg(F.array_sort(F.collect_set(date))).scalar()
    own = df.groupBy(key).agg(F.collect_set(date).alias("_own"))
    return own.select(key, F.explode(F.array_except(every, F.col("_own"))).alias(date))


def assert_complete(df: DataFrame, key: str = GID_2, date: str = DATE) -> None:
    found = missing_combinations(df, key, date).limit(5).collect()
    if found:
        raise ValueError(f"missing combinations, such as {[tuple(r) for r in found]}")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one row per column."""
    require_columns(df, columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "nulls")


def assert_no_nulls(df: DataFrame, columns: Sequence[str]) -> None:
    bad = null_counts(df, columns).where("nulls > 0").collect()
    if bad:
        raise ValueError(f"null covariates: {({r['column']: r['nulls'] for r in bad})}")


def active_regions(df: DataFrame, start: str | None = None, end: str | None = None,
                   cases: str = CASES) -> DataFrame:
    """Region ids and whether any case fell into the training window."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col(DATE) <= F.lit(end).cast("date"))
    hit = F.coalesce(F.max(F.when(inside, F.col(cases) > 0)), F.lit(False))
    return df.groupBy(GID_2).agg(hit.alias("active"))


def outlier_regions(forecast: DataFrame, limit: float = 100e6, keys: Sequence[str] = (HORIZON,)) -> DataFrame:
    """Regions with a missing or absurdly large prediction, per horizon or other keys."""
    return (
        forecast.groupBy(*keys, GID_2)
        .agg(F.bool_or(F.col(PREDICTION).isNull()).alias("has_null"),
             F.coalesce(F.bool_or(F.col(PREDICTION) > limit), F.lit(False)).alias("too_large"))
        .where("has_null or too_large")
    )


def static_covariates(df: DataFrame, columns: Sequence[str], before: str) -> DataFrame:
    """(region, covariate) pairs with at most one distinct value before a date.

    Minimum and maximum tell that without collecting distinct values.
    """
    early = df.where(F.col(DATE) < F.lit(before).cast("date"))
    long = early.select(GID_2, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        GID_2, list(columns), "covariate", "value"
    )
    spread = long.groupBy(GID_2, "covariate").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return spread.where("lo is null or lo = hi").select(GID_2, "covariate")


def rows_per(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values of each column."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def split_future(df: DataFrame) -> DataFrame:
    """Rows and regions of history and future."""
    return df.groupBy(FUTURE).agg(F.count("*").alias("n"), F.count_distinct(GID_2).alias("regions"))
