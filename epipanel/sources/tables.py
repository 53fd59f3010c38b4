"""Stored tables: read, replace, append, list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from epipanel.schema import DATE, GID_2, require_columns
from epipanel.sources.snapshots import Snapshots

# Suffixes tried, in this order, when a table name has none.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
        return True
    except AnalysisException:
        return False


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored table; without a suffix, try Parquet, CSV and JSON in turn."""
    for suffix, fmt in FORMATS.items():
        if path.endswith(suffix):
            if fmt == "parquet" and (table := Snapshots(spark, path)).numbers():
                return table.read()
            reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
            return reader.format(fmt).load(path)
    for suffix in FORMATS:
        if _exists(spark, path + suffix):
            return read_table(spark, path + suffix)
    raise ValueError(f"no table at {path} with any suffix of {list(FORMATS)}")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Replace the table at ``path`` (Parquet; period marks travel with the schema). Read it with :func:`read_table`.

    The new rows are written beside the old ones and become the table by one atomic step, so a table may be replaced by something
    read from it, and a job that fails at any point leaves it as it was.
    """
    if not path.endswith(".parquet"):
        path += ".parquet"
    Snapshots(df.sparkSession, path).replace(df, partition_by)
    return path


def write_by_year(df: DataFrame, path: str, date: str = DATE) -> str:
    """Replace a panel table, one folder per year, so that date filters prune folders."""
    return write_table(df.withColumn("year", F.year(date)), path, ["year"])


def align_to(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of ``df`` in ``target``'s order and types, whatever order they come in."""
    require_columns(df, target.columns)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
                       for f in target.schema.fields])


def unknown_regions(df: DataFrame, regions: DataFrame, key: str = GID_2) -> DataFrame:
    """Region ids of ``df`` outside the closed set ``regions``."""
    return df.select(key).distinct().join(regions.select(key), key, "left_anti")


def append_table(df: DataFrame, path: str, regions: DataFrame | None = None) -> str:
    """Append rows by column name; the first append makes the table.

    With ``regions`` the region ids form a closed set: an id outside it is an error.
    """
    if not path.endswith(".parquet"):
        path += ".parquet"
    if regions is not None:
        strangers = unknown_regions(df, regions).limit(5).collect()
        if strangers:
            raise ValueError(f"region ids outside the closed set: {[r[0] for r in strangers]}")
    spark = df.sparkSession
    table = Snapshots(spark, path)
    if table.numbers():
        df = align_to(df, table.read())
    elif _exists(spark, path):  # files written by others become the first snapshot
        held = spark.read.parquet(path)
        table.replace(held)
        df = align_to(df, held)
    table.append(df)
    return path


def compact_table(spark: SparkSession, path: str) -> None:
    """Put the rows of all appends into one folder; appends that come meanwhile are kept."""
    Snapshots(spark, path).compact(lambda parts: reduce(DataFrame.unionByName, [df for _, df in parts]))


def write_csv(df: DataFrame, path: str) -> str:
    """Scores, weights and metrics as CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def as_view(df: DataFrame, name: str = "data") -> DataFrame:
    """Session table over ``df``, for free SQL."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def user_tables(spark: SparkSession) -> list[str]:
    """Names of the session's tables, without internal ``__*`` ones."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith("__"))


def only_table(spark: SparkSession) -> str | None:
    """The one user table, or None when there are none or several."""
    names = user_tables(spark)
    return names[0] if len(names) == 1 else None


def row_count(spark: SparkSession, name: str) -> int:
    """Rows of a session table; 0 when there is no such table."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0
