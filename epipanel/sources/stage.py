"""Written intermediate tables, for results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="epipanel-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind: what they write is read from its table from then on."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation,
    and later steps still read only the columns they need. The shuffles before
    the table are dropped with the end of the write.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`stage` for a table that is read inside the block only and deleted with its end."""
    spark = df.sparkSession
    path = f"{stage_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
