"""Row and column access to a table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epipanel.functions.periods import align_scalar
from epipanel.functions.scalars import is_finite
from epipanel.schema import CASES, DATE, FUTURE, GID_1, HORIZON, QUANTILE, one_row, require_columns


def columns(df: DataFrame, *names: str) -> DataFrame:
    require_columns(df, names)
    return df.select(*names)


def row_slice(df: DataFrame, start: int, stop: int, order: Sequence[str]) -> DataFrame:
    """Rows ``start`` to ``stop`` (not included) in the given order."""
    return df.orderBy(*order).offset(start).limit(max(stop - start, 0))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def mask(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where a boolean column holds; anything but a boolean is a TypeError."""
    kind = df.select(condition.alias("c")).schema["c"].dataType
    if not isinstance(kind, T.BooleanType):
        raise TypeError(f"a mask must be boolean, not {kind.simpleString()}")
    return df.where(condition)


def query(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a SQL condition."""
    return df.where(condition)


def filter_equal(df: DataFrame, values: dict[str, Any] | None) -> DataFrame:
    """Rows that equal every given value."""
    for name, value in (values or {}).items():
        df = df.where(F.col(name) == value)
    return df


def filter_admin1(df: DataFrame, gid_1: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of the given states: a short list, or a one-column table of any size; None keeps all."""
    if gid_1 is None:
        return df
    if isinstance(gid_1, DataFrame):
        return df.join(gid_1.select(GID_1), GID_1, "left_semi")
    return df.where(F.col(GID_1).isin(*gid_1))


def filter_status(df: DataFrame, statuses: Sequence[str] | None) -> DataFrame:
    if statuses is None:
        return df
    require_columns(df, ["Status"])
    return df.where(F.col("Status").isin(*statuses))


def cutoff(df: DataFrame, date: str | None) -> DataFrame:
    """Rows up to and including a date."""
    return df if date is None else df.where(F.col(DATE) <= F.lit(date).cast("date"))


def cutoff_report(df: DataFrame, date: str, cases: str = CASES) -> DataFrame:
    """Cases (or rows, without a count column) removed and kept by a cutoff."""
    amount = F.col(cases) if cases in df.columns else F.lit(1)
    kept = F.col(DATE) <= F.lit(date).cast("date")
    total = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0)).cast("long")
    return df.agg(total(~kept).alias("removed"), total(kept).alias("remaining"))


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between two dates, each limited to the range of the data."""
    bounds = one_row(df.agg(F.struct(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))))
    low = bounds["lo"] if start is None else F.greatest(align_scalar(start, df), bounds["lo"])
    high = bounds["hi"] if end is None else F.least(align_scalar(end, df), bounds["hi"])
    return df.where(F.col(DATE).between(low, high))


def finite_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.where(is_finite(F.col(truth)) & is_finite(F.col(pred)))


def pick(df: DataFrame, quantile: float | None = None, horizon: int | None = None) -> DataFrame:
    """One quantile level and/or one horizon of a forecast."""
    if quantile is not None:
        df = df.where(F.col(QUANTILE).between(quantile - 5e-7, quantile + 5e-7))  # reaches the scan
    return df if horizon is None else df.where(F.col(HORIZON) == horizon)


def history(df: DataFrame) -> DataFrame:
    return df.where(~F.col(FUTURE))


def future(df: DataFrame) -> DataFrame:
    return df.where(F.col(FUTURE))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null (in ``subset``)."""
    return df.dropna(subset=list(subset) if subset else None)


def to_float32(df: DataFrame) -> DataFrame:
    """Double columns in single precision."""
    return df.select(*[
        F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def zero_missing_history(df: DataFrame, column: str = CASES, flag: str = FUTURE) -> DataFrame:
    """Missing past values count as 0; rows that are neither past nor future go."""
    known = df.where(F.col(flag).isNotNull())
    return known.withColumn(
        column, F.when(F.col(flag), F.col(column)).otherwise(F.coalesce(F.col(column), F.lit(0)))
    )
