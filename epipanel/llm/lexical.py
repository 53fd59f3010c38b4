"""Exact ranked lexical search with per-term geometric blocking.

Documents are vectors of integer impacts, one entry per term. Per term, the posting list is clustered by the similarity of
its documents into blocks, and each block stores the coordinatewise maximum of its documents' vectors. A question's inner
product with that summary bounds the score of every document in the block, so a block is skipped only when this bound is
below the tenth score found so far; all other blocks are scored in full. The clustering decides how much is skipped, never
what is found.

How it runs:

1. Questions are read in blocks of bounded size (``_question_blocks``); each block is one search over all documents. What a
   block ships to the tasks (its vocabulary and its weights) is bounded by that size.
2. One scan of the documents counts all terms and keeps, in shards of at most ``SHARD`` documents, the counts of the terms that
   the block's questions hold (``shards``, written). A very common term is thereby split over all shards.
3. N, L and df come from aggregates over the shards; they make the impacts (``index``), and each shard's posting lists are
   blocked. Documents are compared by sketches (a fixed random projection of their weighted impacts to ``SKETCH`` numbers). A list
   is dealt to evenly spaced members of itself, the centres, and what gathers at a centre is cut into blocks of ``BLOCK``
   documents. A summary leaves out coordinates that no question holding its term asks for.
4. ``_search``: a question walks its lists by falling weight. Documents of earlier lists are done, so the bound of a later block
   counts the remaining terms only; when even the shard's own maxima of these cannot reach the tenth score, the shard is
   done. The tenth score is carried from shard to shard within a task. Each task returns ten rows a question, merged in two steps.

Cases. Null and empty texts have no terms and count nowhere. Documents with one id are documents of their own each; one
without id counts and is ranked, last among equal scores. Items with equal id and text are one item; texts that differ under one
id are ranked apart and told apart by ``variant`` (0 for the first text in order). Items without terms, empty tables: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epipanel.llm.common import stage, table_parts

SHARD, BLOCK, SKETCH = 4096, 128, 32
#: Most pairs of terms that share an item, and most bytes of terms, in a block of questions.
MOST_PAIRS, MOST_BYTES = 1 << 22, 16 << 20

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _LETTERS else 0x20 for c in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


class Questions:
    """A block of questions: numbered terms, and per question its terms with their counts."""

    def __init__(self, asked: list[tuple[int | None, int, dict[bytes, int]]]):
        self.names = [(item, variant) for item, variant, _ in asked]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in own], "i8") for _, _, own in asked]
        self.times = [np.array(list(own.values()), "i8") for _, _, own in asked]

    def coordinates(self) -> list[np.ndarray] | None:
        """Per term, which terms share a question with it; None stands for all (a block of one question)."""
        if len(self.terms) == 1:
            return None
        holders: list[list[int]] = [[] for _ in self.vocabulary]
        for q, own in enumerate(self.terms):
            for t in own.tolist():
                holders[t].append(q)
        return [np.unique(np.concatenate([self.terms[q] for q in qs])) for qs in holders]


def _question_blocks(items: DataFrame, item_column: str, text_column: str) -> Iterator[Questions]:
    """Questions in blocks within ``MOST_PAIRS`` and ``MOST_BYTES`` (a larger question is a block by itself)."""
    own = items.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text")).distinct()
    order = Window.partitionBy("item").orderBy("text")
    own = own.withColumn("variant", F.row_number().over(order) - 1)
    held, pairs, size = [], 0, 0
    for row in own.orderBy("item", "variant").toLocalIterator():
        found = dict(Counter(terms(row["text"].encode("utf-8", "replace") if row["text"] else None)))
        if not found:
            continue
        more, longer = len(found) ** 2, sum(map(len, found))
        if held and (pairs + more > MOST_PAIRS or size + longer > MOST_BYTES):
            yield Questions(held)
            held, pairs, size = [], 0, 0
        held.append((row["item"], row["variant"], found))
        pairs, size = pairs + more, size + longer
    if held:
        yield Questions(held)


def _ints(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def shards(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str = "doc_id", text_column: str = "text",
           rows: int = SHARD, most_bytes: int = 32 << 20) -> DataFrame:
    """Counts of the vocabulary's terms, up to ``rows`` documents a row.

    ``n_docs`` and ``n_terms`` count all documents with terms and all their terms; ``ids``, ``named`` (0: no id), ``sizes`` (terms of
    the document), ``starts``, ``terms`` and ``tf`` hold the documents with at least one term of the vocabulary.
    """
    width = max(1, len(vocabulary))

    def told(ids, sizes, found):
        numbers = np.repeat(np.arange(len(found)), [len(x) for x in found])
        flat = np.concatenate(found)
        held = flat >= 0
        key, tf = np.unique(numbers[held] * width + flat[held], return_counts=True)
        doc, term = key // width, key % width
        some, counts = np.unique(doc, return_counts=True)
        named = np.array([i is not None for i in ids], "u1")[some]
        own = np.array([i or 0 for i in ids], "i8")[some]
        yield pa.record_batch(
            [pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()),
             *_ints(own, named, np.array(sizes, "i8")[some], np.append(0, np.cumsum(counts)).astype("i8"), term.astype("i4"), tf.astype("i4"))],
            ["n_docs", "n_terms", "ids", "named", "sizes", "starts", "terms", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, found, held = [], [], [], 0
        for batch in table_parts(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms(text.as_py())
                if not own:
                    continue
                ids.append(i)
                sizes.append(len(own))
                found.append(np.fromiter(map(vocabulary.get, own, repeat(-1)), "i8", len(own)))
                held += 8 * len(own)
                if len(ids) >= rows or held >= most_bytes:
                    yield from told(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield from told(ids, sizes, found)

    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "n_docs long, n_terms long, ids binary, named binary, sizes binary, starts binary, terms binary, tf binary")


def statistics(shards: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """N, L and, per term of the vocabulary, df."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, "i8")
        for batch in batches:
            for x in batch.column(0):
                df += np.bincount(np.frombuffer(x.as_py(), "i4"), minlength=width)
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], ["term", "df"])

    n, length = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(width, "i8")
    for row in shards.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return n, length, df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], "i8")


def impacts(tf: np.ndarray, sizes: np.ndarray, n: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in documents of the given numbers of terms."""
    if len(sizes) and int(sizes.max()) * n * 75 >= 1 << 63:
        norm = np.array([25 + 75 * int(s) * n // length for s in sizes], "i8")
    else:
        norm = 25 + (75 * sizes * n) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def _spread(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the chosen rows, and how many each has."""
    sizes = starts[chosen + 1] - starts[chosen]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[chosen] - ends + sizes, sizes), sizes


def _blocks(docs: np.ndarray, sketches: np.ndarray, block: int) -> list[np.ndarray]:
    """A posting list dealt to evenly spaced centres of its own, and cut there into blocks."""
    if len(docs) <= block:
        return [docs]
    centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // block)).astype("i8")]
    near = sketches[docs] @ sketches[centres].T
    at = near.argmax(1)
    order = np.lexsort((-near[np.arange(len(docs)), at], at))
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [part[i:i + block] for part in np.split(docs[order], cuts) for i in range(0, len(part), block)]


_INDEX = ("ids binary, named binary, starts binary, terms binary, impacts binary, list_terms binary, list_most binary, list_blocks binary, "
          "block_posts binary, posts binary, block_sums binary, sum_terms binary, sum_most binary")


def index(shards: DataFrame, questions: Questions, n: int, length: int, weight: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocked posting lists with their summaries, a row per shard."""
    width, shared = max(1, len(weight)), questions.coordinates()
    project = np.random.default_rng(13).standard_normal((width, SKETCH)).astype("f4")

    def one(row) -> pa.RecordBatch:
        sizes, starts = np.frombuffer(row["sizes"], "i8"), np.frombuffer(row["starts"], "i8")
        term, tf = np.frombuffer(row["terms"], "i4").astype("i8"), np.frombuffer(row["tf"], "i4").astype("i8")
        per = np.diff(starts)
        doc = np.repeat(np.arange(len(sizes)), per)
        impact = impacts(tf, np.repeat(sizes, per), n, length)
        value = (weight[term] * impact).astype("f4")
        sketches = np.zeros((len(sizes), SKETCH), "f4")
        for i in range(0, len(sizes), 512):  # a part of the shard at a time
            end = min(i + 512, len(sizes))
            lo, hi = starts[i], starts[end]
            sketches[i:end] = np.add.reduceat(project[term[lo:hi]] * value[lo:hi, None], starts[i:end] - lo, axis=0)
        sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)

        order = np.argsort(term, kind="stable")
        names, first = np.unique(term[order], return_index=True)
        most = np.maximum.reduceat(impact[order], first) if len(first) else np.zeros(0, "i8")
        list_blocks, block_sizes, posts, sums, sum_sizes = [0], [], [], [], []
        place = np.full(width, -1)
        for name, docs in zip(names.tolist(), np.split(doc[order], first[1:])):
            parts = _blocks(docs, sketches, block)
            wanted = np.unique(term) if shared is None else shared[name]
            place[wanted] = np.arange(len(wanted))
            posts += parts
            block_sizes += map(len, parts)
            list_blocks.append(len(block_sizes))
            for i in range(0, len(parts), 16):  # summaries of a few blocks at a time
                some = parts[i:i + 16]
                at, each = _spread(starts, np.concatenate(some))
                number = np.repeat(np.repeat(np.arange(len(some)), [len(p) for p in some]), each)
                column = place[term[at]]
                held = column >= 0
                table = np.full((len(some), len(wanted)), -1, "i4")
                np.maximum.at(table.reshape(-1), number[held] * len(wanted) + column[held], impact[at[held]].astype("i4"))
                rows, columns = np.nonzero(table >= 0)
                sums.append((wanted[columns].astype("i4"), table[rows, columns]))
                sum_sizes.append(np.bincount(rows, minlength=len(some)))
            place[wanted] = -1
        whole = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.record_batch(
            [*_ints(np.frombuffer(row["ids"], "i8"), np.frombuffer(row["named"], "u1"), starts, term.astype("i4"), impact.astype("i4"),
                    names.astype("i4"), most.astype("i8"), np.array(list_blocks, "i8"),
                    np.append(0, np.cumsum(block_sizes)).astype("i8"), whole(posts, "i4"),
                    np.append(0, np.cumsum(whole(sum_sizes, "i8"))).astype("i8"),
                    whole([x for x, _ in sums], "i4"), whole([x for _, x in sums], "i4"))],
            [c.split()[0] for c in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch.slice(i, 1).to_pylist()[0])

    return shards.select("ids", "named", "sizes", "starts", "terms", "tf").mapInArrow(run, _INDEX)


_KINDS = {"named": "u1", "terms": "i4", "impacts": "i4", "list_terms": "i4", "posts": "i4", "sum_terms": "i4", "sum_most": "i4"}


class Shard:
    """One shard's blocked posting lists."""

    def __init__(self, row: dict[str, bytes]):
        for name, data in row.items():
            setattr(self, name, np.frombuffer(data, _KINDS.get(name, "i8")))

    def top(self, own: np.ndarray, value: np.ndarray, worth: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores among the best ``k``, all of at least ``floor``, and how many blocks were scored.

        ``own``: the question's terms, ``value``: what one unit of impact in each is worth, ``worth``: room for one number per term of
        the vocabulary, all zero.
        """
        at = np.searchsorted(self.list_terms, own)
        at = np.where(at < len(self.list_terms), at, 0)
        there = (self.list_terms[at] == own) & (value > 0) if len(self.list_terms) else np.zeros(len(own), bool)
        own, value, at = own[there], value[there], at[there]
        order = np.argsort(-value * self.list_most[at], kind="stable")
        own, value, at = own[order], value[order], at[order]
        rest = np.cumsum((value * self.list_most[at])[::-1])[::-1]
        whole = np.zeros_like(worth)
        whole[own] = worth[own] = value
        seen = np.zeros(len(self.starts) - 1, bool)
        docs, scores, scored = np.zeros(0, "i8"), np.zeros(0, "i8"), 0
        for i in range(len(own)):
            if rest[i] < floor:
                break
            lo, hi = self.list_blocks[at[i]], self.list_blocks[at[i] + 1]
            first, last = self.block_sums[lo], self.block_sums[hi]
            bound = np.add.reduceat(worth[self.sum_terms[first:last]] * self.sum_most[first:last], self.block_sums[lo:hi] - first)
            for j in np.argsort(-bound, kind="stable").tolist():
                if bound[j] < floor:
                    break
                found = self.posts[self.block_posts[lo + j]:self.block_posts[lo + j + 1]]
                found = found[~seen[found]]
                if not len(found):
                    continue
                seen[found] = True
                scored += 1
                places, each = _spread(self.starts, found)
                score = np.add.reduceat(whole[self.terms[places]] * self.impacts[places], np.cumsum(each) - each)
                good = score >= floor
                docs, scores = np.append(docs, found[good]), np.append(scores, score[good])
                if len(scores) > k:
                    best = np.lexsort((self.ids[docs], self.named[docs] == 0, -scores))[:k]
                    docs, scores = docs[best], scores[best]
                if len(scores) == k:
                    floor = max(floor, int(scores.min()))
            worth[own[i]] = 0
        worth[own] = 0
        return docs, scores, scored


def _search(index: DataFrame, questions: Questions, weight: np.ndarray, k: int) -> DataFrame:
    width = max(1, len(weight))
    asked = [(own, weight[own] * times) for own, times in zip(questions.terms, questions.times)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int | None]]] = [[] for _ in asked]
        worth = np.zeros(width, "i8")
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                for q, (own, value) in enumerate(asked):
                    floor = -best[q][-1][0] if len(best[q]) == k else 1
                    docs, scores, _ = shard.top(own, value, worth, k, floor)
                    if len(docs):
                        more = zip((-scores).tolist(), (shard.named[docs] == 0).tolist(), shard.ids[docs].tolist())
                        best[q] = sorted(best[q] + list(more))[:k]
        rows = [(q, None if unnamed else i, -s) for q, own in enumerate(best) for s, unnamed, i in own]
        yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["question", "doc_id", "score"])

    found = index.mapInArrow(run, "question long, doc_id long, score long")
    for keys in (["question", F.pmod(F.spark_partition_id(), F.lit(32))], ["question"]):  # two steps, so that no task merges all
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` and ``variant`` of each item's ``k`` best documents of score above 0."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long, variant int"
    out = spark.createDataFrame([], schema)
    for questions in _question_blocks(items, item_column, item_text_column):
        held = stage(shards(docs, questions.vocabulary, id_column, text_column))
        n, length, df = statistics(held, len(questions.vocabulary))
        weight = weights(n, df)
        found = _search(index(held, questions, n, length, weight), questions, weight, k)
        names = spark.createDataFrame([(q, item, variant) for q, (item, variant) in enumerate(questions.names)],
                                      "question long, item_id long, variant int")
        out = out.unionByName(stage(found.join(names, "question").select("item_id", "rank", "doc_id", "score", "variant")))
    return out
