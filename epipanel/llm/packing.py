"""Packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of the longest length (a power of two) as fit, then one piece for each
binary digit of the rest, longest first. Each piece is a sequence of its own, equal lengths share a bucket, so a batch
drawn from one bucket needs no padding and no sequence crosses documents.

Sequences are numbered from 0 by bucket, longest first: each task numbers its own pieces per bucket, and after they are
written, the pieces of earlier tasks and longer buckets are added. Nothing is shuffled but those counts, of which there
is one per task and bucket, unless they outgrow Spark's own limit for a broadcast.

Cases. Null and empty texts are documents of the end id alone: one piece of length 1. Repeated rows are documents of
their own. A null ``doc_id`` stays null. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epipanel.llm.common import stage, table_parts, texts
from epipanel.llm.pieces import encoder as encoder_of


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths that add up to ``n``: ``longest`` as often as it fits, then falling powers of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, longest: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, its task ``part``, its
    ``place`` among the task's pieces of that length, and ``ids`` if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        part, places = TaskContext.get().partitionId(), Counter()
        for batch in table_parts(batches, 2 << 20):
            rows = []
            for doc_id, data in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                data += end
                start = 0
                for n in binary_lengths(len(data) // 4, longest):
                    own = data[4 * start:4 * (start + n)]
                    rows.append((doc_id, start, n, zlib.crc32(own), len(data) // 4, part, places[n], own))
                    places[n] += 1
                    start += n
            columns = list(zip(*rows))
            out = [pa.array(c, pa.int64()) for c in columns[:-1]]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in columns[-1]], pa.list_(pa.int32())))
            yield pa.record_batch(out, [*names, "ids"][:len(out)])

    return texts(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, longest: int = 1024, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``bucket`` (the length's exponent), ``sequence_id`` and ``offset`` (always 0: one piece each)."""
    found = stage(pieces(docs, vocabulary, end_id, longest, with_ids))
    counts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    own = counts.withColumn("inside", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    # one row per length
    buckets = counts.groupBy("length").agg(F.sum("n").alias("all"))
    longer = buckets.select("length", (F.sum("all").over(Window.orderBy(F.col("length").desc())) - F.col("all")).alias("longer"))
    # one row per task and length; stored, so that Spark knows its size and broadcasts it only while it is small
    before = stage(own.join(longer, "length").select("length", "part", (F.col("inside") + F.col("longer")).alias("before")))
    return (found.join(before, ["length", "part"])
            .withColumn("sequence_id", F.col("before") + F.col("place"))
            .withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", F.log2(F.col("length").cast("double")).cast("int"))
            .drop("part", "place", "before"))
