"""Near-duplicate documents by MinHash with banding.

1. Each text becomes the set of its distinct word shingles, and the set's ``BANDS * ROWS`` minima under universal hashes
   ``a * x + b mod 2**32``. Texts with equal sets are one class from here on, stood for by its smallest id.
2. Each band of ``ROWS`` minima is a bucket. Sets of similarity s share a bucket with probability
   ``1 - (1 - s**ROWS)**BANDS``; with 40 bands of 5, fewer than two in ten million pairs at 0.8 share none.
3. Candidate pairs are verified: pairs whose signatures agree in less than ``LEAST_AGREEMENT`` of the minima cannot be
   at 0.8 (seven standard deviations below it); the others are counted exactly, on the full sets of word shingles.
4. Links make components by alternating large-star and small-star.

Not all pairs of a bucket are made. First each member meets its bucket's smallest id. Confirmed links make
components; members of one component need no further link. Then, in buckets that still hold several components, the
members outside the bucket's largest component meet those of other components, in blocks that are compared by
signature and then by full sets inside a task. So a bucket full of copies costs a pair per member, no link between
different components goes untested, and what is not linked never becomes a row.

Cases. Null and empty texts, and texts of white space, have no shingles and no links; with fewer words than a shingle
takes, the whole sequence is the one shingle. Rows without ``doc_id`` are returned without a component, as kept. Each row is
judged by its own text: rows that repeat an id each get a row, and different texts under one id are different documents. A
component is named by its smallest id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epipanel.llm.common import stage, table_parts, texts, words
from epipanel.llm.components import components
from epipanel.llm.hashing import mix, shingle_hashes

BANDS, ROWS = 40, 5
LEAST_AGREEMENT = 0.6
BLOCK = 256

_rng = np.random.default_rng(6)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value under each universal hash, a stretch of shingles at a time."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        np.minimum(out, (_A * x[None, i:i + 512] + _B).min(1), out=out)
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, which holds the band's number."""
    key = _BAND.copy()
    for row in signature.reshape(BANDS, ROWS).T:
        key = mix(key + row.astype(np.uint64))
    return key.view(np.int64)


def _mark(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``mark`` of the text, ``n_shingles``, ``digest`` of the set, ``signature`` (low 16 bits of the minima) and ``buckets``."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("signature", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_parts(batches):
            rows = []
            for doc_id, mark, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text"))):
                found = np.unique(shingle_hashes(words(text), width))
                if not len(found):
                    rows.append((doc_id, mark, 0, None, None, None))
                    continue
                own = minima(found)
                rows.append((doc_id, mark, len(found), xxhash.xxh3_128_digest(found.tobytes()), own.astype("<u2").tobytes(), buckets(own)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts(docs).withColumn("mark", _mark("text")).mapInArrow(
        run, "doc_id long, mark binary, n_shingles long, digest binary, signature binary, buckets array<long>")


def shingles(text: str, width: int) -> set:
    """The set itself, of word tuples."""
    own = words(text)
    return set(zip(*[own[i:] for i in range(width)])) if len(own) >= width else ({tuple(own)} if own else set())


def _alike(one: bytes, two: bytes) -> float:
    return float((np.frombuffer(one, "<u2") == np.frombuffer(two, "<u2")).mean())


def _linked(one: set, two: set, percent: int) -> bool:
    small, large = sorted((len(one), len(two)))
    if not small or 100 * small < percent * large:
        return False
    both = len(one & two)
    return 100 * both >= percent * (len(one) + len(two) - both)


def _linked_pairs(pairs: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that are links. ``own``: ``doc_id``, ``text``, ``signature``. Texts follow signatures that agree."""
    def both(pairs: DataFrame, column: str) -> DataFrame:
        a = own.select(F.col("doc_id").alias("a"), F.col(column).alias("one"))
        b = own.select(F.col("doc_id").alias("b"), F.col(column).alias("two"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "one", "two")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_parts(batches, 4 << 20):
            keep = [_alike(x, y) >= LEAST_AGREEMENT for x, y in zip(batch["one"].to_pylist(), batch["two"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for batch in table_parts(batches, 4 << 20):
            keep = []
            for row in batch.to_pylist():
                if row["a"] != last:
                    last, one = row["a"], shingles(row["one"], width)
                keep.append(_linked(one, shingles(row["two"], width), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    alike = both(pairs, "signature").mapInArrow(agree, "a long, b long")
    return both(alike, "text").mapInArrow(confirm, "a long, b long")


def _links_apart(apart: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that share a bucket, as pairs of components ``u``, ``v``.

    ``apart``: ``doc_id``, its ``component`` and ``largest``, the largest component of a bucket that it is in. The documents outside
    a component that meet it in any bucket are compared with its documents there and with each other, in blocks of
    about ``BLOCK`` by ``BLOCK`` documents. A pair of components needs one link only.
    """
    outside = apart.filter("component <> largest").select("largest", "doc_id", "component").distinct()
    inside = (apart.join(outside.select("largest").distinct(), "largest").select("largest", "doc_id", "component").distinct())
    sizes = (inside.groupBy("largest").agg(F.ceil(F.count("*") / BLOCK).alias("right"),
                                           F.ceil(F.count_if(F.col("component") != F.col("largest")) / BLOCK).alias("left")))

    key = ["largest", "left_block", "right_block"]

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return (rows.join(sizes, "largest").join(own, "doc_id")
                .withColumn(mine + "_block", F.pmod(F.xxhash64("doc_id"), F.col(mine)))
                .withColumn(other + "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
                .select(*[F.col(c).alias(f"{mine}_{c}") for c in (*key, "doc_id", "component", "text", "signature")]))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        if left.num_rows and right.num_rows:
            sets: dict[int, set] = {}

            def of(i, text):
                if i not in sets:
                    sets[i] = shingles(text, width)
                return sets[i]

            names = [*key, "doc_id", "component", "text", "signature"]
            mine, other = left.rename_columns(names).to_pylist(), right.rename_columns(names).to_pylist()
            signs = np.frombuffer(b"".join(r["signature"] for r in other), "<u2").reshape(len(other), -1)
            for x in mine:
                alike = (signs == np.frombuffer(x["signature"], "<u2")).mean(1) >= LEAST_AGREEMENT
                for i in np.flatnonzero(alike):
                    y = other[i]
                    ends = (max(x["component"], y["component"]), min(x["component"], y["component"]))
                    if ends[0] == ends[1] or ends in out:
                        continue
                    if _linked(of(x["doc_id"], x["text"]), of(y["doc_id"], y["text"]), percent):
                        out.add(ends)
        return pa.table([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])

    one, two = dealt(outside, "left", "right"), dealt(inside, "right", "left")
    return (one.groupBy(*one.columns[:3]).cogroup(two.groupBy(*two.columns[:3])).applyInArrow(compare, "u long, v long"))


def _classes(usable: DataFrame) -> DataFrame:
    """``digest``, its smallest row ``rep`` (id and mark), its ``n`` rows and ``node``, a number in the order of ``rep``.

    Numbers keep different texts of one id apart; ranges of rows are numbered in their own tasks.
    """
    parts = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("n"))
    order = [F.col("rep.doc_id"), F.col("rep.mark"), F.col("digest")]
    return stage(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``mark`` and ``n_shingles`` of each row, and ``root``, the id and mark of its component's smallest row.

    Nodes stand in for ``doc_id`` between here and the end.
    """
    own = texts(docs).withColumn("mark", _mark("text"))
    signed = stage(signatures(docs, width))
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    classes = _classes(usable)
    named = classes.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.mark").alias("mark"), "node")
    found = usable.join(named, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    reps = found.select(F.col("node").alias("doc_id"), "signature", "buckets")

    # buckets of several classes, each row with the bucket's smallest id
    rows = reps.select(F.explode("buckets").alias("bucket"), "doc_id")
    several = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    members = stage(rows.join(several, "bucket"))

    # texts of the documents that share a bucket with others
    involved = named.join(members.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    sought = found.select("doc_id", "mark", "signature").join(involved, ["doc_id", "mark"])
    own = stage(own.join(sought, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select(F.col("node").alias("doc_id"), "text", "signature"))

    first = members.filter("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _linked_pairs(first, own, width, percent)
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # what the first links left apart
    placed = stage(members.select("bucket", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                   .select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
             .filter("parts > 1").drop("parts"))
    apart = stage(placed.join(mixed, "bucket").select("doc_id", "component", "largest").distinct())
    bridges = _links_apart(apart, own, width, percent)
    joined = components(bridges)

    final = (found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
             .select("node", F.coalesce("root", "component").alias("component"))
             .unionByName(joined.join(found.select("node"), "node", "left_anti").select("node", "component")))
    roots = classes.select(F.col("node").alias("component"), F.col("rep").alias("root"))
    moved = (classes.join(final.join(roots, "component").select("node", "root"), "node", "left").filter("n > 1 or root is not null")
             .select("digest", F.coalesce("root", "rep").alias("root")))
    return (signed.select("doc_id", "mark", "n_shingles", "digest").join(moved, "digest", "left")
            .select("doc_id", "mark", "n_shingles", F.coalesce("root", F.struct("doc_id", "mark")).alias("root")))


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` (it is that one)."""
    return (_labelled(docs, width, percent)
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("root.doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns kept, one of each component: the smallest id's.

    Of rows with equal id and text one stays; different texts under one id stay or go each by itself; rows without id stay.
    """
    kept = (_labelled(docs, width, percent).filter("doc_id is not null and doc_id = root.doc_id and mark = root.mark")
            .select(F.col("doc_id").alias("key"), "mark").distinct())
    # the row is a struct, so that no name of its columns can clash with the ones added here
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("key"), _mark("text").alias("mark")).filter("key is not null")
    sortable = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = Window.partitionBy("key", "mark").orderBy(F.xxhash64(*sortable))
    found = (rows.withColumn("place", F.row_number().over(one)).filter("place = 1").join(kept, ["key", "mark"], "left_semi").select("row.*"))
    return found.unionByName(docs.filter(docs["doc_id"].isNull()))
