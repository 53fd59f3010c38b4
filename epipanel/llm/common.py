"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epipanel.sources.stage import stage, stage_folder

__all__ = ["Memo", "block_count", "read_table", "stage", "stage_folder", "table_parts", "texts", "words"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the named columns; every other column is left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
                       *[docs[c] for c in more])


def words(text: str) -> list[bytes]:
    """Lower-case A-Z, then the pieces between ASCII white space (space and 0x09 to 0x0D), as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts fill; one pass over all rows."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


class Memo(dict):
    """What ``make`` gives for a key. Keys longer than ``longest`` are not held, and all is forgotten once ``most``
    keys are, so memory stays bounded."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def table_parts(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds much more than ``most_bytes`` unless a single row does."""
    for batch in batches:
        rows = max(1, batch.num_rows)
        step = max(1, int(rows * most_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
