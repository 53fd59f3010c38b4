"""Exact top-k search by inner product, by MaxScore over shards.

A vector's components are terms and the candidates of a shard are kept term by term (postings by column), with each
term's least and largest value. A query bounds what each term can add. Terms are put in order of that bound; the
non-essential ones are as many of the lowest as together stay below the query's current k-th score, so no candidate
can get in by them alone. The essential postings are traversed for all candidates of the shard; then the others are
probed, a few terms at a time, only for candidates whose score so far and the bound of what is left still reach the
k-th score. The k-th score is carried on from shard to shard. Each shard gives k rows per query, and these are merged.

Queries meet shards in tiles: a block of ``BLOCK`` queries and a group of about ``GROUP`` shards. A query block is sent once to each
group and a shard once to each block, and the join's key is the tile, so no task gets all shards of a block. A row of the
join holds one shard and one block. Candidates of other lengths than the query are never compared.

Cases. Vectors that are null, hold null or non-finite components or have no id take no part. Ties go to the smaller id.
Rows that repeat an id are separate candidates. Rows of one query id with equal vectors are one query; different vectors under one
id are asked apart and told apart by ``variant`` (0 for the first in array order). A query never finds rows of its own
id. Fewer candidates than k: all. Empty tables give no rows. Scores are exact: floating point where a bound says that nothing can
be rounded, 64-bit integers where nothing can overflow, Python's integers beyond that. A scaled component or a score that
64 bits cannot hold raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epipanel.llm.common import stage

SHARD, BLOCK, GROUP = 4096, 1024, 16


def _whole(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scaled, floored vectors of the rows that take part, by length."""
    ids, lists = batch.column(0), batch.column(1)
    ok = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype("f8")
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    length = np.diff(offsets)
    ok &= bad[offsets[1:]] == bad[offsets[:-1]]
    for n in np.unique(length[ok]):
        rows = np.flatnonzero(ok & (length == n))
        take = offsets[rows][:, None] + np.arange(n)
        own = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype("<i8")
        scaled = np.floor(flat[take] * scale)
        if scaled.size and float(np.abs(scaled).max()) >= 2.0 ** 63:
            raise OverflowError("a scaled component is beyond 64 bits")
        yield own, scaled.astype("<i8")


def _exact(postings: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which no inner product, nor a sum of bounds, is rounded or wraps."""
    largest = len(postings) * float(np.abs(postings.astype("f8")).max(initial=0)) * float(np.abs(vectors.astype("f8")).max(initial=0))
    kind = "f8" if largest < 2.0 ** 52 else "i8" if largest < 2.0 ** 62 else object
    return postings.astype(kind), vectors.astype(kind)


def shards(vectors: DataFrame, scale: float, rows: int = SHARD) -> DataFrame:
    """``width``, ``ids`` and ``postings`` (term by term) of up to ``rows`` vectors per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def told(width, some):
            ids, values = (np.concatenate(x) for x in zip(*some))
            for i in range(0, len(ids), rows):
                yield pa.record_batch([pa.array([width], pa.int32()), pa.array([ids[i:i + rows].tobytes()], pa.binary()),
                                       pa.array([np.ascontiguousarray(values[i:i + rows].T).tobytes()], pa.binary())],
                                      ["width", "ids", "postings"])

        for batch in batches:
            for ids, values in _whole(batch, scale):
                some = held.setdefault(values.shape[1], [])
                some.append((ids, values))
                if sum(len(x) for x, _ in some) >= rows:
                    yield from told(values.shape[1], some)
                    some.clear()
        for width, some in held.items():
            if some:
                yield from told(width, some)

    return vectors.mapInArrow(run, "width int, ids binary, postings binary")


class Bounds:
    """MaxScore of one query block over one shard."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        self.ids, self.postings = ids, postings
        self.least, self.most = postings.min(1), postings.max(1)

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` (perhaps fewer, none of them below ``floor``, the k-th score so far)."""
        above = np.maximum(query * self.least, query * self.most)
        order = np.argsort(-above, kind="stable")
        rest = np.append(np.cumsum(above[order][::-1])[::-1], 0)  # bound of all terms from here on
        if floor is None:
            essential = len(order)
        else:
            essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(order)
        first = order[:essential]
        score = query[first] @ self.postings[first]
        if floor is None:
            found = np.flatnonzero(self.ids != own)
        else:
            found = np.flatnonzero((score + rest[essential] >= floor) & (self.ids != own))
        score = score[found]
        for i in range(essential, len(order), 8):
            if not len(found):
                break
            more = order[i:i + 8]
            score = score + query[more] @ self.postings[np.ix_(more, found)]
            keep = score + rest[min(i + 8, len(order))] >= floor
            found, score = found[keep], score[keep]
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0,
           id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` and ``variant`` of each query's ``k`` best candidates."""
    spark = vectors.sparkSession

    def plain(df):
        return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def usable(df):
        bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)

    index = stage(shards(plain(vectors), scale))
    order = Window.partitionBy("id").orderBy("v")
    asked = usable(plain(queries)).distinct().withColumn("variant", F.row_number().over(order) - 1)
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = max(1, index.count() // GROUP)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "variant"), F.lit(blocks))).repartition(blocks, "block")

    def pack(group: pa.Table) -> pa.Table:
        out, block = [], group["block"][0].as_py()
        for batch in group.select(["id", "v", "variant"]).combine_chunks().to_batches():
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            variants = batch.column(2).to_numpy(zero_copy_only=False).astype("<i8")
            for ids, values in _whole(batch, scale):
                out.append((values.shape[1], ids.tobytes(), variants[lengths == values.shape[1]].tobytes(), values.tobytes()))
        return pa.table([pa.array([block] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()),
                         *[pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3)]],
                        ["block", "width", "asked", "variants", "vectors"])

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))

    packed = stage(asked.groupBy("block").applyInArrow(pack, "block long, width int, asked binary, variants binary, vectors binary"))
    dealt = index.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("block", each(blocks))
    pairs = dealt.join(packed.withColumn("group", each(groups)), ["group", "block", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                ids, queries = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["asked"], "<i8")
                postings = np.frombuffer(row["postings"], "<i8").reshape(width, len(ids))
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(queries), width)
                if not width:
                    postings, vectors = np.zeros((1, len(ids)), "i8"), np.zeros((len(queries), 1), "i8")
                postings, vectors = _exact(postings, vectors)
                shard, some = Bounds(ids, postings), []
                for own, variant, query in zip(queries.tolist(), np.frombuffer(row["variants"], "<i8").tolist(), vectors):
                    seen = floors.get((own, variant), [])
                    got, score = shard.top(query, own, k, seen[-1] if len(seen) == k else None)
                    floors[own, variant] = sorted(seen + [int(x) for x in score], reverse=True)[:k]
                    some.append((np.full(len(got), own), np.full(len(got), variant), got, score.astype("i8")))
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*some)], ["query_id", "variant", "vec_id", "score"])

    found = (pairs.select("width", "ids", "postings", "asked", "variants", "vectors")
             .mapInArrow(run, "query_id long, variant long, vec_id long, score long"))
    order = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", F.col("variant").cast("int").alias("variant")))
