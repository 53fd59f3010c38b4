"""Column names, table schemas and small schema guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "Date"
GID_1 = "GID_1"
GID_2 = "GID_2"
CASES = "Cases"
FUTURE = "future"
PREDICTION = "prediction"
QUANTILE = "quantile"
HORIZON = "horizon"
MODEL = "model"
SAMPLE = "sample"

# Quantile levels of every published forecast.
QUANTILE_LEVELS = (
    0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99,
)

LINE_LIST = T.StructType([
    T.StructField(DATE, T.DateType()),
    T.StructField(GID_2, T.StringType()),
    T.StructField(GID_1, T.StringType()),
])

FORECAST_SAMPLES = T.StructType([
    T.StructField(GID_2, T.StringType()),
    T.StructField(DATE, T.StringType()),
    T.StructField(SAMPLE, T.LongType()),
    T.StructField(PREDICTION, T.DoubleType()),
    T.StructField(CASES, T.DoubleType()),
])

WEEKLY_FEED = T.StructType([
    T.StructField("data_iniSE", T.LongType()),
    T.StructField("casos", T.LongType()),
    T.StructField("Localidade_id", T.LongType()),
    T.StructField("SE", T.LongType()),
])

REGION_COLUMNS = ("GID_0", "GID_1", "NAME_1", "GID_2", "NAME_2", "HASC_2")

PERIOD_FREQ = "period_freq"


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ValueError when ``df`` lacks any of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")


def with_period(df: DataFrame, freq: str, column: str = DATE) -> DataFrame:
    """Mark ``column`` as holding period ends of frequency ``freq``.

    The mark lives in the field metadata, so it survives a Parquet round trip.
    """
    meta = {PERIOD_FREQ: freq, "how": "end"}
    return df.withMetadata(column, meta)


def period_freq(df: DataFrame, column: str = DATE) -> str | None:
    """Frequency mark of ``column``, or None for a plain date."""
    return df.schema[column].metadata.get(PERIOD_FREQ)


# rows that a part of a spread table may grow to in the steps after it; shapes the work only
PART_ROWS = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash ``df`` by ``keys`` for steps that compute much on few bytes.

    Adaptive execution merges shuffle partitions by size, which would leave
    such a step to a task or two; an explicit number of parts keeps them apart.
    ``rows`` is what the table grows to before the next shuffle: with more of
    them there are more parts, not larger ones, so sorts and Python batches of a
    task do not grow with the table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // PART_ROWS)), *keys)


def one_row(df: DataFrame) -> Column:
    """First column of a one-row aggregate as a scalar subquery.

    Spark runs the subquery once and uses its value as a literal, so global
    bounds reach every row without a cross join.
    """
    return df.scalar()


def literal_array(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
