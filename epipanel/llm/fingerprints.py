"""Document fingerprints by one-permutation MinHash.

A text's shingles (five words; fewer words make one shingle of them all) are hashed once. The upper bits of a hash name
its bin, and each bin keeps its smallest hash. A bin that stays empty takes the value of another: its own fixed series of
bins is walked until one is found that is not empty (optimal densification), the same series for every text, so equal
choices stay equal. A series is 4096 draws, then a permutation of all bins, so it always ends at a filled one. Each bin's value is mixed with
the bin's number, and the low ``BITS`` bits of that are packed into the fingerprint: in texts of a few shingles many bins
hold one value, and different values still agree by chance in a bin here and there, not in all at once.

Two fingerprints agree in a share of bins that is the shingle sets' Jaccard similarity plus chance agreements of low
bits, one in 2**BITS; ``likeness`` takes those out and clips to 0..1.

Words are the pieces between ASCII white space, A-Z lower-cased. A text without words has the empty fingerprint, which is
like another empty one (1) and like nothing else (0).

``with_next`` sees documents in ascending ``doc_id`` (nulls first, ties by text). It range-partitions and sorts them once;
inside a part each document meets its follower; the last of a part meets the first of the next part that has rows by a
join on part numbers, and the very last meets the very first. Repeated rows follow each other. A single document follows
itself. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.llm.common import stage, table_parts, texts, words
from epipanel.llm.hashing import mix, shingle_hashes

BINS, BITS, WIDTH, STEPS = 512, 4, 5, 64
_BIN = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

# For each bin its series of bins, in steps of 64; steps beyond the first are made when they are needed.
_series: list[np.ndarray] = []


def _steps(i: int) -> np.ndarray:
    while len(_series) <= i:
        _series.append(np.random.default_rng([BINS, len(_series)]).integers(0, BINS, (64, BINS)))
    return _series[i]


@lru_cache(1)
def _orders() -> np.ndarray:
    """For each bin (column) a permutation of all bins, for what the draws do not lead to a filled one."""
    return np.random.default_rng([BINS, STEPS]).permuted(np.tile(np.arange(BINS)[:, None], BINS), axis=0)


def densified(filled: np.ndarray) -> np.ndarray:
    """For each bin the bin whose value it takes: itself where filled. One bin at least is."""
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if filled.sum() == 1:
        source[:] = np.flatnonzero(filled)[0]
        return source
    i = 0
    while len(empty):
        series = (_steps(i) if i < STEPS else _orders())[:, empty]
        hits = filled[series]
        at = hits.argmax(0)
        found = hits[at, np.arange(len(empty))]
        source[empty[found]] = series[at, np.arange(len(empty))][found]
        empty = empty[~found]
        i += 1
    return source


def fingerprint(tokens: list[bytes]) -> np.ndarray:
    """The low bits of each bin; empty without words."""
    hashes = np.sort(shingle_hashes(tokens, WIDTH))
    if not len(hashes):
        return np.zeros(0, np.uint8)
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]] = hashes[first]
    filled[bins[first]] = True
    # the bin goes into the low bits, so that bins that borrow one value agree by chance one by one
    return (mix(values[densified(filled)] + _BIN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray) -> bytes:
    bits = np.unpackbits(values[:, None], axis=1, bitorder="little")[:, :BITS]
    return np.packbits(bits, bitorder="little").tobytes()


def _text(name: str) -> Column:
    """A packed fingerprint as text (base64 without line ends)."""
    return F.regexp_replace(F.base64(name), "[\\r\\n]", "").alias(name)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 1 / (1 << BITS)
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_parts(batches):
            own = [packed(fingerprint(words(t))) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(own, pa.binary())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint binary").select("doc_id", _text("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
                  ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_KINDS = {pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
_NAMES = ", ".join(f"{f.name} {_KINDS[f.type]}" for f in _ROW)


def _row(doc_id, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    new = edited(text, following)
    other = fingerprint(words(new))
    return (doc_id, len(text), hashlib.sha256(new.encode()).digest(), packed(own), packed(other),
            likeness(own, other), likeness(own, after))


def with_next(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint against its edited text's and the next document's."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edge_schema = pa.schema([*_ROW, ("part", pa.int64()), ("edge", pa.string()), ("edge_text", pa.string())])

    def told(rows: list[tuple], part: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), edge_schema)], schema=edge_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in table_parts(batches, 2 << 20):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = fingerprint(words(text))
                if before is None:
                    rows.append((doc_id, *[None] * 6, part, "first", text))
                else:
                    rows.append((*_row(*before, text, own), part, None, None))
                before = (doc_id, text, own)
            yield told(rows, part)
        if before is not None:
            yield told([(before[0], *[None] * 6, part, "last", before[1])], part)

    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ranged = texts(docs).repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    staged = stage(ranged.mapInArrow(run, f"{_NAMES}, part long, edge string, edge_text string"))

    # one row per part that has rows: what follows the last document of each
    first = staged.filter("edge = 'first'").select("part", F.col("edge_text").alias("following"))
    numbers = staged.filter("edge = 'first'").select("part")
    by_part = Window.orderBy("part")
    follows = numbers.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(
        by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    last = staged.filter("edge = 'last'").select("part", "doc_id", F.col("edge_text").alias("text"))
    ends = (last.join(follows, "part").join(first.withColumnRenamed("part", "next_part"), "next_part")
            .select("doc_id", "text", "following"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(r["doc_id"], r["text"], fingerprint(words(r["text"])), r["following"], fingerprint(words(r["following"])))
                    for r in batch.to_pylist()]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

    found = staged.filter("edge is null").select(_ROW.names).unionByName(ends.mapInArrow(meet, _NAMES))
    return found.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), _text("fingerprint"),
                        _text("edited_fingerprint"), "near_edited", "near_next")
