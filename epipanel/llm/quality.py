"""Document quality by Bradley-Terry ranking.

A document's score is a linear function of counts and shares taken from its whole text. It is learned from preference
pairs: a document labelled 1 is preferred to one labelled 0 with probability sigmoid(score difference), and the weights
minimise the logistic loss on the feature differences of the pairs (with a small ridge, by Newton steps). The scores of
the labelled rows are then cut at the quantile that splits the labels best (mean of the two labels' shares of right
calls), and the returned score is ``sigmoid(score - cut + logit(level))``: ``level`` at the cut.

The fit uses a bounded sample, by default at most ``MOST_ROWS`` labelled rows, spread by a hash of the id, and ``MOST_PAIRS``
pairs; scoring covers all rows. Only the text makes a score. Labels other than 0 and 1, null ids and ids without a
document are left out. Null and empty texts have all counts zero and get a score. Without both labels in the sample,
every score is ``level``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import table_parts, texts, words

MOST_ROWS, MOST_PAIRS = 12_000, 60_000
LEVEL = 0.7

_CLASSES = np.zeros(256, np.uint8)  # 0 other signs
for _i, _some in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\f", b".,;:'\"-?()",
                            bytes(range(128, 256)), bytes(range(0, 9)) + bytes(range(14, 32)) + b"\x7f"], 1):
    _CLASSES[list(_some)] = _i


def features(text: str) -> list[float]:
    """Counts and shares of a whole text."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    data = np.frombuffer(raw, np.uint8)
    classes = _CLASSES[data]
    share = np.bincount(classes, minlength=8) / n
    odd = (classes == 0)
    odd_runs = float((odd[1:] & odd[:-1]).sum()) / n
    tokens = words(text)
    m = max(1, len(tokens))
    seen = Counter(tokens)
    top = sum(c for _, c in seen.most_common(3)) / m
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1)
    pairs = len(set(zip(tokens, tokens[1:]))) / max(1, len(tokens) - 1) if len(tokens) > 1 else 1.0
    same = sum(map(bytes.__eq__, tokens, tokens[1:])) / m
    short = sum(1 for c in seen.values() if c == 1) / m
    lines = raw.split(b"\n")
    filled = [x for x in lines if x]
    distinct_lines = len(set(filled)) / max(1, len(filled))
    closed = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in filled) / max(1, len(filled))
    small = len(zlib.compress(raw, 1)) / n
    return [np.log1p(n), np.log1p(m), *share.tolist(), odd_runs, top, len(seen) / m, np.log1p(len(seen)) / np.log1p(m), float(lengths.mean()),
            float(lengths.std()), np.log1p(float(lengths.max())), pairs, same, short, distinct_lines, closed, np.log1p(len(filled)),
            np.log1p(n / max(1, len(filled))), small, raw.count(b". ") / m, raw.count(b",") / m, raw.count(b"|") / m,
            raw.count(b"http") / m, raw.count(b"@") / m]


N_FEATURES = 30


def _wide(x: np.ndarray) -> np.ndarray:
    """Standard scores and their squares, both bounded, so that too much can count like too little."""
    x = np.clip(x, -4, 4)
    return np.hstack([x, np.minimum(x * x, 9)])


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    level: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = _wide((x - self.mean) / self.scale) @ self.weights - self.cut + np.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, most_pairs: int = MOST_PAIRS, ridge: float = 1e-3, level: float = LEVEL) -> Ranking:
    """Weights from pairs of rows labelled 1 and 0."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(2 * N_FEATURES), 0.0, level)
    wide = _wide((x - mean) / scale)
    rng = np.random.default_rng(0)
    n = min(most_pairs, len(good) * len(bad))
    # every row of the rarer label is used equally often, the other is drawn
    few, many = (good, bad) if len(good) < len(bad) else (bad, good)
    a, b = np.resize(rng.permutation(few), n), rng.choice(many, n)
    sign = 1.0 if few is good else -1.0
    d = sign * (wide[a] - wide[b])
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ p / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = wide @ w
    ordered = np.sort(s)
    cuts = (ordered[1:] + ordered[:-1]) / 2  # the quantiles between two rows
    sorted_good, sorted_bad = np.sort(s[good]), np.sort(s[bad])
    right = 1 - np.searchsorted(sorted_good, cuts) / len(good) + np.searchsorted(sorted_bad, cuts) / len(bad)
    # of cuts that are equally good, the lowest: it keeps most
    return Ranking(mean, scale, w, float(cuts[np.argmax(right >= right.max() - 1e-12)]), level)


def _features_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``x``, the features of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_parts(batches):
            x = [features(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch([*[batch[k] for k in keep], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, level: float = LEVEL) -> Ranking:
    """Fit on at most ``most_rows`` labelled documents (``labels``: ``doc_id``, ``quality``)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
             .filter("quality = _other").drop("_other")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    # at most most_rows rows of two numbers, so the broadcast is bounded
    rows = _features_of(texts(docs).join(F.broadcast(known), "doc_id"), "doc_id", "quality").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["quality"] for r in rows]), level=level)


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (1 from ``level`` on) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_parts(batches):
            s = ranking.score(np.array([features(t) for t in batch["text"].to_pylist()]).reshape(-1, N_FEATURES))
            yield pa.record_batch([batch["doc_id"], pa.array(s), pa.array((s >= ranking.level).astype("i4"))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The documents, all columns kept, that are not rejected."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table_parts(batches):
            if not batch.num_rows:
                continue
            s = ranking.score(np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES))
            yield batch.filter(pa.array(s >= ranking.level))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", rest: int = 2, of: int = 4):
    """True where crc32 of the id's text leaves ``rest``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == rest, F.lit(True))
