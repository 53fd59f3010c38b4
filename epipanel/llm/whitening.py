"""Embedding whitening, with the components found by QDWH spectral divide and conquer.

The covariance of the fit list is split again and again: the polar factor of the covariance less a shift has the eigenvalues +1 above
the shift and -1 below, so half of it plus the identity projects on the space above. QDWH, the dynamically weighted Halley
iteration, finds the polar factor with QR decompositions only. An orthonormal basis of both spaces splits the matrix in two,
and each part is split further, the upper one first, until single components are left or enough of them are found.

How it runs: entries become integers ``floor(scale * c) + offset``. The fit list is each distinct integer vector once; a common vector
shrinks to a row per task before it is shuffled. Sums and centred products are added up inside tasks, and a row per pair of
dimensions leaves each task. Only sums (d numbers), products (d * d) and the projection (d times at most ``most``) pass through the driver;
they are bounded by the dimension, not by the rows. Projecting is one scan of the table.

Cases. Vectors that are null or hold null or non-finite entries are left out; all others give rows, those without id and repeated
ones too. Vectors of different lengths are fitted apart, each length on its own. A dimension of space in which the fit list
does not vary (eigenvalue below ``FLAT`` of the largest) is no component; if none varies, as with a single distinct vector or
empty vectors, there are no rows. Entries beyond 2**53 after scaling, and deviations beyond 2**63, raise an error rather than wrap.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import stage

FLAT = 1e-11


def polar(a: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    low = 1e-16  # no singular value that matters is smaller
    for _ in range(30):
        near = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        root = np.sqrt(1 + near)
        a_k = root + 0.5 * np.sqrt(8 - 4 * near + 8 * (2 - low ** 2) / (low ** 2 * root))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c_k) * x, np.eye(n)]))[0]
        now = b_k / c_k * x + (a_k - b_k / c_k) / np.sqrt(c_k) * (q[:n] @ q[n:].T)
        now = (now + now.T) / 2
        moved, x = np.linalg.norm(now - x), now
        low = min(1.0, low * (a_k + b_k * low ** 2) / (1 + c_k * low ** 2))
        if low > 1 - 1e-15 and moved < tolerance:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant spaces above and below a shift; None when ``a`` is a multiple of the identity."""
    n, size = len(a), np.linalg.norm(a)
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= 4 * np.finfo(float).eps * size:
        return None
    middle = float(np.median(np.diag(a)))
    rng, best = np.random.default_rng(n), None
    # the median of the diagonal halves most matrices; the mean lies between the extremes of all
    for shift in (middle, mean, (middle + mean) / 2, mean + 1e-3 * size / n, mean - 1e-3 * size / n):
        u = polar(a - shift * np.eye(n))
        above = (u + np.eye(n)) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < n:
            continue
        basis = above @ rng.standard_normal((n, rank))
        for _ in range(2):
            basis = above @ np.linalg.qr(basis)[0]
        q = np.linalg.qr(basis, mode="complete")[0]
        left = np.linalg.norm(q[:, :rank].T @ a @ q[:, rank:])  # what still joins the two
        if best is None or left < best[0]:
            best = (left, q[:, :rank], q[:, rank:])
        if left <= 8 * np.finfo(float).eps * n * size:
            break
    return best[1:] if best else None


def components(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; the largest ``most`` of them."""
    n = len(a)
    most = n if most is None else min(most, n)
    if n <= 1 or not most:
        return np.diag(a)[:most].copy(), np.eye(n)[:, :most]
    parts = _split(a)
    if parts is None:
        return np.diag(a)[:most].copy(), np.eye(n)[:, :most]
    values, vectors = [], []
    for basis in parts:  # everything above the shift comes first
        own = basis.T @ a @ basis
        e, v = components((own + own.T) / 2, most - sum(map(len, values)))
        values.append(e)
        vectors.append(basis @ v)
        if sum(map(len, values)) >= most:
            break
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def points(vectors: DataFrame, scale: float, offset: int, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``x``, the integer vectors of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")

    def whole(c: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * c)
        return F.when(F.abs(c) * float(scale) <= float(1 << 53), scaled + offset).otherwise(
            F.raise_error(F.lit("an entry is too large to be scaled exactly")).cast("long"))

    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(id_column).cast("long").alias("id"), F.transform(v, whole).alias("x"))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors, by length (0 left out)."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for width in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == width)
        yield rows, flat[offsets[rows][:, None] + np.arange(width)]


def _moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: how many vectors, and their sums by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for rows, x in _matrices(batch.column(0)):
                own = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                own[0] += len(rows)
                big = x.astype(object).sum(0) if len(x) * float(np.abs(x).max()) >= 2.0 ** 62 else x.sum(0)
                own[1] = [a + int(b) for a, b in zip(own[1], big)]
        rows = [(w, i, n, str(s)) for w, (n, sums) in held.items() for i, s in enumerate(sums)]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))],
                              ["width", "i", "n", "s"])

    found = fit.select("x").mapInArrow(run, "width int, i int, n long, s string")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in (found.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
                .orderBy("width", "i").toLocalIterator()):
        out.setdefault(row["width"], (row["n"], []))[1].append(int(row["s"]))
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact; objects where 64 bits would not do."""
    if n * float(np.abs(x).max(initial=0)) < 2.0 ** 62 and max(map(abs, sums)) < 2 ** 62:
        return n * x - np.array(sums, "i8")
    return n * x.astype(object) - np.array(sums, object)


def _products(fit: DataFrame, moments: dict[int, tuple[int, list[int]]], project: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Per length: sums of products of the centred vectors (projected first, when ``project`` says so)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                width = x.shape[1]
                n, sums = moments[width]
                y = (_centred(x, n, sums) / n).astype("f8")
                if project is not None:
                    y = y @ project[width]
                held[width] = held.get(width, 0) + y.T @ y
        rows = [(w, i, g[i, i:]) for w, g in held.items() for i in range(len(g))]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                               pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))], ["width", "i", "g"])

    found = fit.select("x").mapInArrow(run, "width int, i int, g array<double>")
    out: dict[int, np.ndarray] = {}
    for row in (found.select("width", "i", F.posexplode("g").alias("j", "g")).groupBy("width", "i", "j").agg(F.sum("g").alias("g"))
                .toLocalIterator()):
        width = row["width"]
        size = project[width].shape[1] if project is not None else width
        g = out.setdefault(width, np.zeros((size, size)))
        g[row["i"], row["i"] + row["j"]] = g[row["i"] + row["j"], row["i"]] = row["g"]
    return out


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 16, scale: float = 64.0, offset: int = 1_000_000, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """Each vector on its first ``most`` components, scaled to unit variance, a row per vector and component.

    ``n`` is the size of the fit list, ``deviation`` the exact sum over dimensions of ``(n * x - sums)**2``, ``explained`` the component's share of the
    variance, ``identity_error`` the largest entry by which the fit list's whitened covariance, measured by a pass over it, is off the identity.
    """
    rows = points(vectors, scale, offset, id_column, vector_column)
    fit = stage(rows.select("x").distinct())
    moments = _moments(fit)
    project, explained, error = {}, {}, {}
    for width, products in (_products(fit, moments) if moments else {}).items():
        cov = products / moments[width][0]
        e, v = components(cov, most)
        good = e > FLAT * max(float(e[0]) if len(e) else 0.0, np.finfo(float).tiny)
        project[width], explained[width] = v[:, good] / np.sqrt(e[good]), e[good] / np.trace(cov)
    if project:
        for width, products in _products(fit, moments, project).items():
            error[width] = float(np.abs(products / moments[width][0] - np.eye(len(products))).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for own, x in _matrices(part.column(1)):
                    width = x.shape[1]
                    n, sums = moments[width]
                    y, k = _centred(x, n, sums), project[width].shape[1]
                    if width * float(np.abs(y).max(initial=0)) ** 2 >= 2.0 ** 62:
                        y = y.astype(object)
                    deviation = (y * y).sum(1)
                    white = (y / n).astype("f8") @ project[width]
                    each = lambda a, t: pa.array(np.repeat(a, k), t)
                    count = len(own)
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                         pa.array([n] * (count * k), pa.int64()), pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                         pa.array(white.reshape(-1)), pa.array(np.tile(explained[width], count)),
                         each(np.full(count, error[width] if k else 0.0), pa.float64())],
                        [c.split()[0] for c in OUTPUT.split(", ")])

    return rows.select("id", "x").mapInArrow(run, OUTPUT)
