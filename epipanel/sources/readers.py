"""Readers for the file kinds that feed a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epipanel.functions.periods import season_month_end
from epipanel.schema import (
    DATE, FORECAST_SAMPLES, GID_2, LINE_LIST, REGION_COLUMNS, WEEKLY_FEED, require_columns,
)

# Feature blocks of the 330-value region embedding (first, length).
EMBEDDING_BLOCKS = {"search": (0, 128), "maps": (128, 128), "weather": (256, 74)}


def read_line_list(spark: SparkSession, path: str, schema: T.StructType = LINE_LIST) -> DataFrame:
    """CSV line list with a header: one row per case."""
    return spark.read.csv(path, header=True, schema=schema)


def read_forecast_samples(spark: SparkSession, path: str) -> DataFrame:
    """Forecast draws made elsewhere, as CSV; dates as text become dates."""
    df = spark.read.csv(path, header=True, schema=FORECAST_SAMPLES)
    return df.withColumn(DATE, F.to_date(DATE))


def read_weekly_feed(spark: SparkSession, path: str) -> DataFrame:
    """JSON feed of weekly records; week starts come as milliseconds since 1970."""
    feed = spark.read.json(path, schema=WEEKLY_FEED)
    return weekly_records(feed)


def weekly_records(feed: DataFrame) -> DataFrame:
    """Weekly feed records with a date: ``Date`` is the first day of the week."""
    return feed.select(
        F.to_date(F.timestamp_millis("data_iniSE")).alias(DATE),
        F.col("Localidade_id").cast("string").alias("code"),
        F.col("casos").cast("long").alias("Cases"),
    )


def monthly_totals(weekly: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Weekly counts to month totals, each week counted in the month of its first day."""
    return (
        weekly.groupBy(*keys, F.last_day(DATE).alias(DATE))
        .agg(F.sum("Cases").cast("long").alias("Cases"))
    )


def read_climate_index(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width text of a three-month climate index (``SEAS YR TOTAL ANOM``)."""
    return climate_index(spark.read.text(path))


def climate_index(lines: DataFrame) -> DataFrame:
    """Text lines ``SEAS YR TOTAL ANOM`` to month ends with ``TotalONI, AnomONI``."""
    parts = F.split(F.trim("value"), r"\s+")
    return (
        lines.select(parts.alias("p"))
        .where((F.size("p") == 4) & (F.col("p")[0] != "SEAS"))
        .select(
            season_month_end(F.col("p")[0], F.col("p")[1]).alias(DATE),
            F.col("p")[2].cast("double").alias("TotalONI"),
            F.col("p")[3].cast("double").alias("AnomONI"),
        )
    )


def read_gridded(spark: SparkSession, path: str, metric: str | None = None) -> DataFrame:
    """Gridded values in long form: one row per (metric, date, cell)."""
    cells = spark.read.parquet(path)
    require_columns(cells, ["metric", DATE, "x", "y", "value"])
    return cells if metric is None else cells.where(F.col("metric") == metric)


def write_gridded(cells: DataFrame, path: str) -> str:
    """Gridded values by metric and date folder, so readers prune to what they need."""
    cells.write.mode("overwrite").partitionBy("metric", DATE).parquet(path)
    return path


def region_dimension(regions: DataFrame) -> DataFrame:
    """The six columns of the region reference layer."""
    require_columns(regions, REGION_COLUMNS)
    return regions.select(*REGION_COLUMNS)


def municipality_codes(df: DataFrame, code: str, state: str, name: str) -> DataFrame:
    """Code list under fixed names: ``code, ADM1, ADM2``."""
    return df.withColumnsRenamed({code: "code", state: "ADM1", name: "ADM2"}).select(
        F.col("code").cast("string").alias("code"), "ADM1", "ADM2"
    )


def first_embedding(df: DataFrame, order: str, key: str = GID_2) -> DataFrame:
    """First row of each region by ``order``."""
    return df.groupBy(key).agg(F.min_by("embedding", order).alias("embedding"))


def embedding_block(df: DataFrame, start: int, length: int) -> DataFrame:
    """A block of embedding features (``start`` counted from 0)."""
    return df.withColumn("embedding", F.slice("embedding", start + 1, length))


def wide_to_embedding(df: DataFrame, key: str = GID_2, prefix: str = "feature") -> DataFrame:
    """Columns ``feature0, feature1, ...`` as one array."""
    names = sorted(
        (c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):])
    )
    return df.select(key, F.array(*[F.col(c).cast("float") for c in names]).alias("embedding"))


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; the rank filter also prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
