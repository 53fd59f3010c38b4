"""Keyed statistics store: look up many keys, insert or replace records.

Records only ever get appended, with a batch number; a lookup takes the newest
record of a key. So an update writes its own rows, and a lost executor or a failed
job leaves no half-written state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epipanel.schema import DATE, GID_2
from epipanel.sources.snapshots import Entry, Snapshots

KEYS = ("metric", DATE, GID_2)


def newest(records: DataFrame, keys: Sequence[str] = KEYS, batch: str = "batch") -> DataFrame:
    """One record per key: the one of the highest batch."""
    values = [c for c in records.columns if c not in (*keys, batch)]
    packed = records.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(batch, *values)).alias("_r")
    )
    return packed.select(*keys, *[F.col("_r")[c].alias(c) for c in values])


def lookup(records: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Newest records of the wanted keys; the keys cut the store down first."""
    hits = records.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return newest(hits, keys)


def misses(records: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wanted keys the store does not hold."""
    return wanted.select(*keys).distinct().join(records.select(*keys), list(keys), "left_anti")


def get_record(records: DataFrame, metric: str, date: str, gid_2: str) -> DataFrame:
    """Newest record of one key; the three equalities reach the scan."""
    one = records.where(
        (F.col("metric") == metric) & (F.col(DATE) == F.lit(date).cast("date")) & (F.col(GID_2) == gid_2)
    )
    return newest(one)


class StatStore:
    """Statistics table in a folder, keyed by (metric, Date, GID_2).

    A record's batch is the number of the snapshot that added it, so adding reads nothing but the list of folders, and of two writers
    at once one comes after the other. When ``most`` folders have gathered they are merged into one that holds each key once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = KEYS, most: int = 8):
        self.spark, self.keys, self.most = spark, tuple(keys), most
        self.table = Snapshots(spark, path)

    @staticmethod
    def _numbered(parts: list[tuple[Entry, DataFrame]]) -> DataFrame:
        """Rows of all folders with their batch; a merged folder brings its own."""
        whole = [df if "batch" in df.columns else df.withColumn("batch", F.lit(e["number"]).cast("long")) for e, df in parts]
        return reduce(DataFrame.unionByName, whole)

    @property
    def records(self) -> DataFrame | None:
        _, entries = self.table.newest()
        return self._numbered([(e, self.table.folder(e)) for e in entries]) if entries else None

    def add(self, records: DataFrame) -> int:
        """Insert records; those of known keys replace the old ones. Returns the batch's number."""
        missing = [k for k in self.keys if k not in records.columns]
        if missing:
            raise ValueError(f"records lack key column(s) {missing}")
        held = self.records
        if held is not None:
            records = records.select(*[c for c in held.columns if c != "batch"])
        number = self.table.append(records)
        if len(self.table.newest()[1]) > self.most:
            self.compact()
        return number

    def compact(self) -> None:
        """Keep the newest record of each key, in one folder."""
        def merge(parts: list[tuple[Entry, DataFrame]]) -> DataFrame:
            rows = self._numbered(parts)
            best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), F.struct("batch", *[
                c for c in rows.columns if c not in (*self.keys, "batch")])).alias("_r"))
            return best.select("_r.*")

        self.table.compact(merge)

    def get(self, wanted: DataFrame) -> DataFrame | None:
        held = self.records
        return None if held is None else lookup(held, wanted, self.keys)

    def missing(self, wanted: DataFrame) -> DataFrame:
        held = self.records
        return wanted.select(*self.keys).distinct() if held is None else misses(held, wanted, self.keys)
