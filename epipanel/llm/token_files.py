"""Token-id files of patched frame-of-reference blocks.

Format, little-endian. A file is a run of blocks, then a table of block starts, then a footer:

- block: u32 minimum, u16 values, u8 width, u8 reserved, u16 exceptions, u16 reserved; the values less the minimum, their
  low ``width`` bits packed in a row from the lowest bit; then the exceptions' places (u16 each) and high parts (u32 each).
- table: u64 byte start of each block.
- footer: u64 ids, u32 block size, u32 blocks, the text ``PFOR``.

A block's width is the least that holds the given share of its values; those that need more are exceptions. Block i
starts at id i * block size, so a reader finds any id by the table alone.

Ids of documents lie in ascending ``doc_id`` order (nulls first; among equal ids in the order of the texts' first 64
characters, then of their hashes), each document closed by the end id. Documents are range-partitioned in that order, so
rows of one id need not share a task; each task writes one file under a name of its own attempt, and the index that the tasks return (file, first id, documents) names only files of tasks that
succeeded. A document's end need not be guessed from its ids: the index holds the lengths.

Cases. Null and empty texts have the end id alone. Repeated rows are written again. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epipanel.llm.common import stage, stage_folder, table_parts, texts
from epipanel.llm.pieces import encoder as encoder_of

BLOCK = 4096
SHARE = 0.95
_HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("_a", "u1"), ("odd", "<u2"), ("_b", "<u2")])
_FOOT = np.dtype([("ids", "<u8"), ("size", "<u4"), ("blocks", "<u4"), ("mark", "S4")])


def pack_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block of at most 65,535 ids (unsigned 32-bit, at least one)."""
    least = ids.min()
    over = (ids - least).astype("<u4")
    widths = np.zeros(len(over), "u1")
    some = over > 0
    widths[some] = np.frexp(over[some].astype("f8"))[1]  # bit lengths
    width = int(np.sort(widths)[min(len(over) - 1, int(np.ceil(share * len(over))) - 1)])
    odd = np.flatnonzero(widths > width)
    low = over & np.uint32((1 << width) - 1)
    bits = np.unpackbits(low.view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    head = np.array([(least, len(ids), width, 0, len(odd), 0)], _HEAD)
    high = (over[odd].astype("u8") >> np.uint64(width)).astype("<u4")
    return head.tobytes() + np.packbits(bits.ravel(), bitorder="little").tobytes() + odd.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    head = np.frombuffer(data, _HEAD, 1)[0]
    n, width, odd = int(head["n"]), int(head["width"]), int(head["odd"])
    at = _HEAD.itemsize
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, "u1", size, at), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), "u1")
    wide[:, :width] = bits
    out = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().copy()
    if odd:
        places = np.frombuffer(data, "<u2", odd, at + size)
        high = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
        out[places] |= (high.astype("u8") << np.uint64(width)).astype("<u4")
    return out + head["least"]


class Writer:
    """Takes ids in order and writes whole blocks as they fill."""

    def __init__(self, sink, size: int = BLOCK):
        self.sink, self.size, self.rest = sink, size, np.zeros(0, "<u4")
        self.starts, self.at, self.n = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.size * self.size
        for i in range(0, whole, self.size):
            self._block(self.rest[i:i + self.size])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.starts.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array([(self.n, self.size, len(self.starts), b"PFOR")], _FOOT).tobytes())
        self.sink.close()


class Reader:
    """Ids of any range of a file, by its table of block starts."""

    def __init__(self, source):
        self.source, end = source, source.size()
        foot = np.frombuffer(source.read_at(_FOOT.itemsize, end - _FOOT.itemsize), _FOOT)[0]
        if foot["mark"] != b"PFOR":
            raise ValueError("not a file of token blocks")
        self.size, blocks, table = int(foot["size"]), int(foot["blocks"]), end - _FOOT.itemsize - 8 * int(foot["blocks"])
        self.starts = np.append(np.frombuffer(source.read_at(8 * blocks, table), "<u8"), np.uint64(table)).astype(np.int64)

    def chunks(self, first: int, n: int, blocks_at_once: int = 256) -> Iterator[np.ndarray]:
        """The ``n`` ids from ``first`` on, some blocks at a time."""
        i, last = first // self.size, (first + n - 1) // self.size
        while i <= last:
            j = min(last + 1, i + blocks_at_once)
            data = self.source.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i]))
            own = [unpack_block(data[self.starts[k] - self.starts[i]:self.starts[k + 1] - self.starts[i]]) for k in range(i, j)]
            ids = np.concatenate(own)
            lo = max(0, first - i * self.size)
            yield ids[lo:first + n - i * self.size]
            i = j


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, run_ids: int = 1 << 20) -> DataFrame:
    """Write the files to ``folder`` (any address pyarrow opens) and return their index: ``file``, ``part``,
    ``first`` (place in the file of the run's first id), ``n_ids``, ``doc_ids`` and ``lengths``. A run holds whole
    documents of about ``run_ids`` ids."""
    schema = "file string, part long, first long, n_ids long, doc_ids array<long>, lengths array<long>"
    fields = pa.schema([("file", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        part = TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(folder)
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.pfor"
        end = np.array([end_id], "<u4").tobytes()
        writer, first, held, doc_ids, lengths = None, 0, 0, [], []

        def told():
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "first": first, "n_ids": held,
                                                "doc_ids": doc_ids, "lengths": lengths}], fields)

        for batch in table_parts(batches, 2 << 20):
            if writer is None:
                store.create_dir(path, recursive=True)
                writer = Writer(store.open_output_stream(f"{path}/{name}"))
            coded = [x + end for x in encoder.encode(batch["text"].to_pylist())]
            writer.add(np.frombuffer(b"".join(coded), "<u4"))
            for doc_id, data in zip(batch["doc_id"].to_pylist(), coded):
                doc_ids.append(doc_id)
                lengths.append(len(data) // 4)
                held += lengths[-1]
                if held >= run_ids:
                    yield told()
                    first, held, doc_ids, lengths = first + held, 0, [], []
        if writer is not None:
            writer.close()
            if lengths:
                yield told()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the start of the text and its hash split the rows of one id, without texts among the sampled bounds
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text"), F.col("text")]
    ranged = texts(docs).repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    return stage(ranged.mapInArrow(run, schema))


def read(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, from the files."""
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("part") / 1024))
    groups = totals.groupBy("group").agg(F.sum("n").alias("all"))
    earlier = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")
    # one row per file; stored, so that Spark knows its size and broadcasts it only while it is small
    before = stage(totals.withColumn("inside", inside).join(earlier, "group")
                   .select("part", (F.col("inside") + F.col("earlier")).alias("before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as source:
                    reader = Reader(source)
                    chunks = reader.chunks(row["first"], row["n_ids"])
                    ids, crcs, starts, start = np.zeros(0, "<u4"), [], [], row["before"] + row["first"]
                    for n in row["lengths"]:
                        crc, left = 0, n
                        while left:
                            if not len(ids):
                                ids = next(chunks)
                            crc = zlib.crc32(ids[:left].tobytes(), crc)
                            took = min(left, len(ids))
                            ids, left = ids[took:], left - took
                        crcs.append(crc)
                        starts.append(start)
                        start += n
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                                       pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = index.join(before, "part")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    folder = f"{stage_folder(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(docs, vocabulary, folder, end_id), folder)
